"""DataFrame operators of path counting."""
