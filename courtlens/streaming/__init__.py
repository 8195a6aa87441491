"""Incremental loading of keyed tables from a stream of files.

The same operators as in batch, applied to each micro-batch; a version is published whole, so readers see no half load.
"""
