"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  ``registry`` collects the
queries and the SQL that checks them.
"""
