"""Operators on DataFrames: hashing, lookups, shapes, rasters, folds, history, validation."""
