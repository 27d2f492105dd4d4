"""Contract lineage over many repositories, as Spark DataFrame jobs."""
