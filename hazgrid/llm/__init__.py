"""Training-data operators: text quality, de-duplication, scans, packing, tokens and media.

Nothing outside this subpackage imports it.
"""
