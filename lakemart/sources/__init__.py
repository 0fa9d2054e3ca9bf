"""Sources: readers for landed files (S-01..S-11) and the driver-table adapters."""
