"""Readers and writers of the field's text formats."""
