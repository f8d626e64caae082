"""Reading and writing logs and the stored table."""
