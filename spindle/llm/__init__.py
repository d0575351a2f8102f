"""Operators of a training-data pipeline: search, licences, quality, chat, near-duplicates, BPE, WARC, rules, PII, packing."""
