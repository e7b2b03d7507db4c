"""Operators of the reconciliation of trade papers: extraction, classification, linking, comparison, rules, state, reports."""
