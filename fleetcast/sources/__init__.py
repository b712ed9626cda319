"""Readers, writers and run ledgers."""
