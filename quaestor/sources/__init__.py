"""Readers, writers and the views that every query is written against."""
