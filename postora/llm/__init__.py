"""Training-corpus operators: licences, mixing, deduplication, sharding, archives, tokens, decontamination, quality."""
