"""Training-data operators: fingerprints, packing, classifiers, deduplication, tokenizers, n-gram models.

Each operator lives in a module of its own with a general interface; ``queries.py``
binds them to the driver's tables.  Nothing outside this package imports it.
"""
