"""Training-data operators: quality, secrets, near-duplicates, mixing, tokens,
language, sharding and vector search.  Nothing else in the library imports
this subpackage."""
