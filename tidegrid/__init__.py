"""Time-series, metadata and event analytics as Catalyst plans."""
