"""Type families, sanitizers and casts: functions of Columns."""
