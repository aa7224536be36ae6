"""Readers: bytes of a document to evidence rows."""
