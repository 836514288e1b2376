"""Readers of documents: binary files in, pages with a status out."""
