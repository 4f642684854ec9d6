"""Operators over DataFrames: cascades, decontamination, duplicates, sampling, joins, metrics, ratings, reports."""
