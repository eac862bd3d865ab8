"""sparkwright plans."""
