"""Readers, writers, fingerprints and registries."""
