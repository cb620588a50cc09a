"""Decoding, assembling and counting of reads."""
