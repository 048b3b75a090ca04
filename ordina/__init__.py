"""Cohort analytics with an ordinal target, written as Spark DataFrames."""
