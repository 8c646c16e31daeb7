"""Spark jobs for table preparation, clustering, model evaluation and raster features."""
