"""Training-data operators: deduplication, language, quality, privacy, mixing and scoring."""
