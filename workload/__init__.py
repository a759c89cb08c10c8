"""The toolkit at work on the given tables: feeds, queries, and the same queries in SQL."""
