"""Readers, payload clean-up and keyed upserts."""
