"""Dataset resolution, multi-format scans and sinks."""
