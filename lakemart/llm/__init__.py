"""Operators for preparing training text: fingerprints, URL rules, language and quality models,
tokenization, similarity joins, repeated lines, license and benchmark scans.

Nothing else in the library imports this subpackage."""
