"""Readers for corpora and side tables."""
