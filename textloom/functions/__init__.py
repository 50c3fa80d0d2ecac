"""Part of the textloom package."""
