"""Jobs over files as they arrive."""
