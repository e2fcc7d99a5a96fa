"""Training-data operators: packing, dedup, chat windows, WARC, sharding, rules, BPE, fingerprints.

Nothing else in the library imports this subpackage.
"""
