"""Table migration, change replay and verification as Spark jobs."""
