"""Readers and writers of graph and result formats, and remote endpoints."""
