"""cohortlake: student-success analytics as PySpark DataFrame programs."""
