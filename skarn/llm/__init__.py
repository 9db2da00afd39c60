"""Training-data operators: filters, deduplication, tokenisation and shards over whole corpora.

Nothing outside this folder imports it; it imports nothing from the rest of the package.
"""
