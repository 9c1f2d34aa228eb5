"""Keyed time series and event streams on Spark: operators are plain DataFrame -> DataFrame functions."""
