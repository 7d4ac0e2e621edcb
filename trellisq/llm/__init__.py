"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; each module holds one
operator and, beside it, the thin ``opN_*`` query over the driver's tables.
"""
