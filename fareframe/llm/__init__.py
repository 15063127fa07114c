"""Operators for training-text pipelines: near and exact duplicates, tokens, language, fingerprints, mixing."""
