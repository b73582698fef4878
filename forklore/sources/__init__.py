"""Scans of exports, logs and documents; sinks and keyed patches."""
