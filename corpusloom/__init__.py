"""Text-dataset preparation, checking and scoring as Spark jobs."""
