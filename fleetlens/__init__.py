"""Fleet telemetry analytics as Spark jobs over tables."""
