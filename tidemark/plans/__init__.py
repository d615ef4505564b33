"""Composite commands: build, run, report, minimum detectable effects."""
