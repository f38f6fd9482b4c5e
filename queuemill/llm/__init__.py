"""Operators for preparing large text corpora, with their queries."""
