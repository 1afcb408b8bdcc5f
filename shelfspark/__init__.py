"""Bibliographic retrieval and document analytics as Spark plans."""
