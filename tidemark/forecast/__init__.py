"""Forecast frames, models, scoring, registry."""
