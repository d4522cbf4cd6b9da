"""Graph drawing and graph analysis as Spark queries."""
