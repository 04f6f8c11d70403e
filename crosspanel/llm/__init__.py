"""Training-data operators: mixing, dedup, quality, sharding, packing, extraction.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
