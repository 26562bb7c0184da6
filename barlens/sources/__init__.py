"""Scans, sinks and table derivations."""
