"""Scalar functions: hashes, paths, chunks, slices, typed attributes."""
