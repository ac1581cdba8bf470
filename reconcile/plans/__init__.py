"""Compositions of operators into whole plans."""
