"""Readers, writers and the denormalised views over normalised tables."""
