"""Portuguese text phonetics and corpus analytics as Spark DataFrame transforms."""
