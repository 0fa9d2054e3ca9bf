"""Structured Streaming ingestion of landed CDC / log files.

The reference loads each day's landed files in batch.  The same stateless fact jobs
(filters, projections, map lookups, broadcast dictionary joins) run unchanged on a
file stream: new landing files are picked up incrementally and appended to the
dt-partitioned fact through the exactly-once file sink (its metadata log plus the
checkpoint make a restarted or retried micro-batch write nothing twice).
"""
