"""The library's sources."""
