"""Spark jobs for offer catalogs, engagement metrics, ranking and messaging."""
