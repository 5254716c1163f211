"""Operators over corpora of documents: filters, deduplication, mixing, sharding, output."""
