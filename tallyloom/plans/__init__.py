"""Domain tables, registered queries and their SQL."""
