"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it may be removed as a
whole.  Each module holds one operator with a general interface, and
``queries`` binds them to the driver tables.
"""
