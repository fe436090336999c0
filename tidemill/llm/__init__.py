"""Operators for large training corpora.

Nothing else in the library imports this subpackage.  Every module holds one operator with a general
interface; ``registry`` binds them to the driver's tables as the ``opN_*`` queries.
"""
