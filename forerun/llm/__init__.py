"""Training-data operators for large text corpora; nothing else in forerun imports this package."""
