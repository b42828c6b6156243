"""Operators for large text corpora: one module for each, their queries in ``queries``."""
