"""Operators over tracks: layout, detectors, reconstruction, grouping, media and storage views."""
