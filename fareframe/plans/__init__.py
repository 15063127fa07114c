"""Jobs composed of operators and sources."""
