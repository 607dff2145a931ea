"""Whole pipelines and the registry of queries run over a scale-factor folder."""
