"""Readers and writers: CSV flow files, history tables, metric records, label maps."""
