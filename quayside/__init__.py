"""Reconciliation of trade paperwork, and preparation of text corpora, as Spark jobs."""
