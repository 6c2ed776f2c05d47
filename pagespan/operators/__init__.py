"""Part of pagespan: operators."""
