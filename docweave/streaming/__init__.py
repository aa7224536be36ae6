"""The same readers over files as they arrive."""
