"""Content inspection, search and audit analytics as DataFrame operators."""

__version__ = "0.1.0"
