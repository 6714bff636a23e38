"""Spark-first analytics over spatial cells, rays, masks, instances and event streams."""
