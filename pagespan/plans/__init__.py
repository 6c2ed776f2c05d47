"""Part of pagespan: plans."""
