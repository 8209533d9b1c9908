"""Training-data operators on documents: scoring, filtering, deduplication, decontamination and token output."""
