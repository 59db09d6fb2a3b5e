"""Operators for building training corpora: quality, media, chat, dedup, mixing, fingerprints, LM scores, PII, secrets, packing, repeated passages, whitening, repair."""
