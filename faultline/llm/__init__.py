"""Corpus operators for training data: packing, search, near duplicates, filters.

Each module holds one operator over ordinary DataFrames; ``queries`` registers
one query per operator. Nothing else in the library imports this subpackage.
"""
