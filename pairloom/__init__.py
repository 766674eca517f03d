"""Paired-corpus engine: every step of building and using a source/decompiled corpus as DataFrame operators."""
