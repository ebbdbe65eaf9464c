"""Training-data operators: fingerprints, chat formatting, decontamination, LM scoring,
sharding, page extraction, mixing, similarity join, quality scoring and id storage.

Nothing outside this package imports it."""
