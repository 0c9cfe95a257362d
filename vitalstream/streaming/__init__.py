"""Scoring of streaming input with stored models."""
