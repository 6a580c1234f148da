"""Corpus analytics on PySpark: collocation mining, association measures and word vectors over parsed text."""
