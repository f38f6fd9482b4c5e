"""Readers of requests and writers of answers and reports."""
