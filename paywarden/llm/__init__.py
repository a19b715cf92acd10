"""Operators for the preparation of training text: filters, classifiers, duplicates, scans and tokens."""
