"""Training-data operators: quality, deduplication, decontamination, language models, packing, archives and licences."""
