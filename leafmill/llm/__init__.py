"""Training-data operators: decontamination, near-duplicates, PII, language, packing and the like.

Nothing else in the library imports this subpackage.
"""
