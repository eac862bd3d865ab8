"""sparkwright functions."""
