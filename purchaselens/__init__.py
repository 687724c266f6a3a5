"""Purchase analytics as DataFrame functions for Spark."""

__version__ = "0.1.0"
