"""Readers, contract checks over raw files, writers and publishing."""
