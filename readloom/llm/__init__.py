"""Training-data operators: deduplication, language ID, packing, sharding, mixing, media, licences, fingerprints, token counts.

Nothing else in the library imports this subpackage.
"""
