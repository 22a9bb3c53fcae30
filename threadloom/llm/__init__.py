"""Operators of a training-data pipeline: tokens, shards, rules, media, duplicates, packing, toxicity, archives, languages, mixing."""
