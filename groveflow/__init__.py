"""groveflow: rollout and search-tree analytics as Spark DataFrame jobs."""
