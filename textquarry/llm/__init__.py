"""Training-data operators: quality, privacy, tokens, deduplication, archives and decontamination.

Nothing else in the library imports this package; it stands on PySpark, numpy and the
tokenizer libraries alone.
"""
