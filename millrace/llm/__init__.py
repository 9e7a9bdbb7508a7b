"""Operators for preparing text corpora: filters, deduplication, decontamination, scoring, packing."""
