"""Operators on series, windows, spectra, bands and transfer functions."""
