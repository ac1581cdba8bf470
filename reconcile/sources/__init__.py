"""Readers and writers; everything is a Spark source or sink."""
