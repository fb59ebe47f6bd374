"""Readers: typed JSON lines, document collections, judgements, run ledgers."""
