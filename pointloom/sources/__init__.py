"""Readers, writers and generators of clouds."""
