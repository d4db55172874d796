"""Operators that prepare text corpora for training: dedup, filters, scoring, packing, chat."""
