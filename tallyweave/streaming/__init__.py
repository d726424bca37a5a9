"""Intentionally empty: the analyses this library covers have no streaming source, state or window."""
