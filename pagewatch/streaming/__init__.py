"""The same jobs over streams."""
