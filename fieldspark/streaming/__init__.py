"""Incremental spectrograms over streams of samples."""
