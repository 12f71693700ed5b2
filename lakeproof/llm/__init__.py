"""Training-data operators: filters, deduplication, decontamination, tokenising, sharding and scoring.

Nothing outside this subpackage imports it, except ``__spark_entry__`` and ``corpus_pipeline``.
"""
