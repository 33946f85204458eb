"""Operators for preparing text corpora: scoring, tokenising, de-duplicating, packing, archiving and searching.

Nothing else in the library imports this subpackage.
"""
