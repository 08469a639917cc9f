"""Interval, event and text analytics as plain DataFrame functions on PySpark."""
