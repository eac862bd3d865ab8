"""sparkwright sources."""
