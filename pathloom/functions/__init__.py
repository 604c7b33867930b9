"""Reading queries and workloads."""
