"""Orders of evaluation and what they cost."""
