"""Training-data pipeline operators (language ID, dedup, decontamination, mixing, archives, token output)."""
