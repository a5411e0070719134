"""Readers: tables, dictionaries, feeds, pages, search results."""
