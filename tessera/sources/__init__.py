"""Collections on disk: the catalog and the tables of chunks, vectors and postings."""
