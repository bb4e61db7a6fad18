"""Operators on tall tables ``stim, n, x`` and array tables ``stim, frame, v``."""
