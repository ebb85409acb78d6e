"""Operators for preparing training data: duplicates, filters, classifiers, packing and token files.

Nothing outside this folder imports it. ``queries`` holds the registered queries.
"""
