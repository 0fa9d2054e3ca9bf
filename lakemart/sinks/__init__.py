"""Sinks and table management (K-01..K-18).  The only module that writes."""
