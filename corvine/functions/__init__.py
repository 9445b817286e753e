"""Part of corvine."""
