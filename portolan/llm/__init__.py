"""Operators for preparing training text: deduplication, decontamination, tokenising, scoring, language and licence labels.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
