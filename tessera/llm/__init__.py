"""Operators for large-scale training-data pipelines (dedup, language ID, mixing, PII, BPE, search)."""
