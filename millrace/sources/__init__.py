"""Readers, decoders, writers and output mapping."""
