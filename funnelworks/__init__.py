"""Turns impression, click and payment events into a modelling table of look-back features.

``operators`` are functions from DataFrames to DataFrames; ``sources`` reads and
writes named datasets; ``plans`` ties both into named pipelines; ``streaming``
runs the row-wise operators on streams.
"""

__version__ = "0.1.0"
