"""Claims derived from the star-schema tables, the registered queries and their SQL."""
