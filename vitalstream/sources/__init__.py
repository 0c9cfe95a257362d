"""Readers, writers, stored models and intermediate tables."""
