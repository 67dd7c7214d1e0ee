"""Operators for preparing training corpora: filtering, deduplication, tokens, mixing."""
