"""Which computed stretches stay, under a memory budget."""
