"""Training-data operators: scoring, filtering, duplicate removal, mixing and formatting."""
