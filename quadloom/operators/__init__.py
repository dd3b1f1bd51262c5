"""Data-processing operators over statement and record tables."""
