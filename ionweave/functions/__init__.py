"""Column expressions and scalar schedules."""
