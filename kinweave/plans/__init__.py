"""Whole flows: operational analysis, synthetic benchmark, feedback audit."""
