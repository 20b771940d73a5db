"""Requests in words: spans, value links, decision oracles, composition, saved definitions."""
