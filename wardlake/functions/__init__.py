"""Column builders: each returns Spark columns that Catalyst plans with the rest of the query."""
