"""Operators for large text and media corpora; nothing outside this subpackage imports it."""
