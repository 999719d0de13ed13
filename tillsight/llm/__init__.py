"""Operators for preparing training data; nothing else in the library imports them.

Every operator is a module with a general interface. ``queries`` holds the thin
registered queries and their SQL; ``corpus_pipeline.py`` at the top of the
repository chains five of the operators.
"""
