"""Training-data operators: scanning, deduplication, mixing, packing, chat formatting and scoring as Spark jobs."""
