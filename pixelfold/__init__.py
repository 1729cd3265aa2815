"""Raster codecs, layout search and palette quantization on Spark DataFrames."""

__version__ = "0.1.0"
