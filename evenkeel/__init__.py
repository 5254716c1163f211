"""Confound and effect-attribution analysis over Spark DataFrames."""
