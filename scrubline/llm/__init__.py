"""Operators for preparing training text: duplicates, tokens, privacy, extraction, quality, language, archives."""
