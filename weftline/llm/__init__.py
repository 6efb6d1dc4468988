"""Operators for preparing training data: deduplication, decontamination, filters, packing, archives.

Nothing else in the library imports this subpackage.
"""
