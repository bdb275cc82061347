"""A PySpark library of jobs for watching published pages at scale."""
