"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface;
``catalog`` registers the thin ``opN_<name>`` queries over the driver
tables.  Nothing outside this folder imports it.
"""
