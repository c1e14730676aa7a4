"""Reading feeds and writing reports."""
