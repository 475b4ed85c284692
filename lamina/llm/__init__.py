"""Operators for large text and vector corpora.

Each module holds one operator with a general interface; ``queries`` holds the thin
contract queries built on them.  Nothing outside this folder imports it.
"""
