"""Warehouse jobs (J-*) and worked queries (Q-*), each a function over DataFrames."""
