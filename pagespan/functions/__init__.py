"""Part of pagespan: functions."""
