"""Column expressions of raster analytics."""
