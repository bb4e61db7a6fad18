"""Readers and writers: tables, annotation files, waveforms, feature stores."""
