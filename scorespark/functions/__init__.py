"""Column expressions of the score-event model."""
