"""Readers and writers: whole files, drawings as text."""
