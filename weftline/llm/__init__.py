"""Training-data operators: tokenise, deduplicate, clean, score, pack and shard text corpora.

Nothing outside this subpackage imports it.
"""
