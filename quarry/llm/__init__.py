"""Operators for preparing training text: quality, dedup, packing, tokens, scans."""
