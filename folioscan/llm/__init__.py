"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries over the standard tables and their SQL.
"""
