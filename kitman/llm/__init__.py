"""Operators of a training-data pipeline: sharding, URL filters, near and
substring dedup, token files, decontamination, mixing, quality, language,
fingerprints.  Nothing outside this subpackage imports it."""
