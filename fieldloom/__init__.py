"""Survey and corpus analytics as Spark jobs."""
