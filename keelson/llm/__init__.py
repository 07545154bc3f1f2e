"""Training-data operators: tokenization, media, fingerprints, models, scans, mixing.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
