"""Tessera: text retrieval, its evaluation and text-data operators as Spark plans."""
