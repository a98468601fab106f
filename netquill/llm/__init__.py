"""Corpus operators for language-model training data.

Self-contained: nothing outside this subpackage imports it.
"""
