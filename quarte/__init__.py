"""Motion and match analytics for two-person exchanges, written for PySpark."""
