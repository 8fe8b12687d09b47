"""postora: a search and retrieval engine whose index, versions and stored fields are DataFrames."""
