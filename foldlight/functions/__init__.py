"""Column functions: spectra, indices, labels."""
