"""rastrel: raster, contour and corpus analytics expressed as PySpark plans."""
