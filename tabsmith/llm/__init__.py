"""Operators of a training-data pipeline: quality rules, formatting, joins,
language-model scoring, packing, classifiers, token files, BPE, line
deduplication and fingerprints. Nothing outside this subpackage imports it."""
