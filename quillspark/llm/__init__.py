"""Training-data operators: dedup, packing, media, PII, tokenizers, language and toxicity.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
