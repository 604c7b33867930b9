"""A query engine for typed graphs, and corpus operators beside it."""
