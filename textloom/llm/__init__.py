"""Training-data operators: licence scans, sharding, dedup, packing, filters.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and the entry
module load it from :mod:`textloom.llm.queries`.
"""
