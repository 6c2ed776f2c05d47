"""Part of pagespan: sources."""
