"""plinth: directory and entity-graph analytics as Spark DataFrame jobs."""
