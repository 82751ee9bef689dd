"""Training-data operators: packing, tokenizing, deduplication, media, chat and toxicity.

Nothing else in the library imports this subpackage.
"""
