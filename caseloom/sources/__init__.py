"""Reading cases and writing results."""
