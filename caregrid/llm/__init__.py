"""Operators for preparing training text: privacy, licences, packing, language, duplicates, search, mixing, toxicity.

Nothing else in the library imports this subpackage.
"""
