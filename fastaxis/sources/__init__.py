"""Readers: driver tables as domain views, velocity models, waveform archives."""
