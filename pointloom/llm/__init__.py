"""Training-data operators: media, packing, fingerprints, BPE, WARC, URLs, HTML, dedup, quality.

Nothing else in the library imports this subpackage.
"""
