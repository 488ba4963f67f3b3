"""Raster-to-sample analytics as Spark DataFrame operators.

Layers are pixel tables with an affine catalog. Every operator takes and returns DataFrames and every random step
takes a seed.
"""
