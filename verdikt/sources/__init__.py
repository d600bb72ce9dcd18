"""Readers and writers around the evaluation tables."""
