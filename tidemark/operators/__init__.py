"""Relational operators over versions, write records, locks and shards."""
