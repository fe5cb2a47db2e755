"""Readers, writers, the dataset registry and resumable jobs."""
