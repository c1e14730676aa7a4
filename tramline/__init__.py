"""Transit feed validation and analytics on Spark."""
