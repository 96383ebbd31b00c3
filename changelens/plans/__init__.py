"""End-to-end flows and the registered query catalogue."""
