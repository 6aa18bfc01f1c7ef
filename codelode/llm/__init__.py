"""Training-data operators: tokenising, scoring, formatting, deduplication, media, sharding and mixing.

Nothing outside this package imports it.
"""
