"""Operators for language-model training data; nothing else in the library imports them.

``queries`` lists one query per operator over the given tables.
"""
