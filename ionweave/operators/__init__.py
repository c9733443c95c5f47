"""Distributed operators over spectra, peaks, vectors and edges."""
