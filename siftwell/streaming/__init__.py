"""The streaming inbox."""
