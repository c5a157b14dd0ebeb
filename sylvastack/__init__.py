"""Raster time-series and disturbance-mapping analytics as Spark DataFrame programs."""
