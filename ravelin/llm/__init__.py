"""Corpus operators: scoring, packing, search, tokenising, language, deduplication and quality.

Nothing outside this folder imports it, so it can be removed without harm to the rest.
"""
