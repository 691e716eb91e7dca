"""Relational operators: index build and lookup, ranking, codecs, evaluation."""
