"""Column-level functions: they build expressions and never run a job."""
