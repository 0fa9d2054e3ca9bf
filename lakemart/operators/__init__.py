"""Reusable operators the warehouse jobs are composed from."""
