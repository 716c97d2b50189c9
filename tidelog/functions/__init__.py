"""Column functions: key hashing and the sizes and bytes of records."""
