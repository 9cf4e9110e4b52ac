"""Column-level building blocks: every function returns a Spark Column."""
