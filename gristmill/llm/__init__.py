"""Training-data operators: dedup, scoring, scanning, mixing and counting over text corpora.

Nothing outside this subpackage imports it; see ``queries.py`` for the registered queries.
"""
