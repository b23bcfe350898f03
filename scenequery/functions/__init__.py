"""Functions of the raster and catalogue engine."""
