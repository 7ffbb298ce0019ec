"""Training-data operators: filtering, near-duplicate search, scans and packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
