"""Operators for preparing large text corpora.

Every operator takes a DataFrame with at least ``doc_id`` and ``text`` and
ignores further columns unless its docstring says otherwise. Nothing else in
the library imports this subpackage.
"""
