"""Training-data operators: quality, personal data, packing, duplicates, extraction, chat and language."""
