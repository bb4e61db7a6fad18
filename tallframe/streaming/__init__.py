"""Streams of samples in buffered frames."""
