"""postloom: listing aggregation, entity resolution, classification and matching as Spark jobs."""
