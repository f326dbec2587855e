"""Training-data operators: scanning, fingerprinting, tokenising, joining and packing of text corpora.

Nothing outside this subpackage imports it.
"""
