"""Training-data operators: deduplication, classifiers, mixing and packing of documents.

Nothing outside this subpackage imports it.
"""
