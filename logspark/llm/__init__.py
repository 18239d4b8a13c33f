"""Operators for preparing training text.

Nothing else in the library imports this subpackage; it can be deleted
as a whole.  Modules are imported one by one, so that a Python worker
loads only what its task needs.
"""
