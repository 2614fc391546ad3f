"""Lodestone: a Spark-first engine for cleaning, checking, comparing, splitting and modelling tabular data."""
