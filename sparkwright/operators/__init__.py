"""sparkwright operators."""
