"""Operators on tables of pixels, spectra and samples."""
