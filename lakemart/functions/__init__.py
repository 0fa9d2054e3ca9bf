"""Scalar helpers (F-*) and fixed code values."""
