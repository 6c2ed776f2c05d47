"""Part of pagespan: streaming."""
