"""Reading and writing of chunk tables."""
