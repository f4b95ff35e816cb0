"""Document analytics on Spark: cleaning, extraction, privacy, classification, evaluation."""
