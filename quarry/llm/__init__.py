"""Training-data operators: scans, deduplication, packing, scoring and mixing of text corpora.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
