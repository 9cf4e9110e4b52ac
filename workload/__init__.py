"""The queries the repository is checked and timed with, and their SQL definitions."""
