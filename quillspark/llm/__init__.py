"""Training-data operators: filtering, mixing, tokenising, deduplication, archives and scoring."""
