"""Readers, table inventory, and the append-only result tables."""
