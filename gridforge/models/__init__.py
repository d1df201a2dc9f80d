"""Models of the engine."""
