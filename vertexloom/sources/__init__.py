"""Readers and derived graphs."""
