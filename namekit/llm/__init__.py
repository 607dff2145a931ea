"""Operators for building training data: exact top-k search, sharding, benchmark decontamination,
substring dedup, URL rules, toxicity, token counts, personal data, byte-level BPE and near-duplicates.

Each module has one operator. An operator selects the key and text columns it was told to use, so
further columns of the input never clash with its own. Nothing outside this package imports it.
"""
