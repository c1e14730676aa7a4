"""Operators for preparing large text corpora, each usable on its own DataFrame.

Nothing outside this subpackage imports it.
"""
