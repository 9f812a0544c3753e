"""Graph-centric risk analytics and record processing on Spark."""
