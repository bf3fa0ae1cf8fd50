"""Readers and writers for records, pixels, manifests and metric logs."""
