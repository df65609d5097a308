"""Training-data operators. Nothing outside this folder imports it; ``corpus_pipeline.py`` strings five of them together."""
