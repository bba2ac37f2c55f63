"""The query catalogue: registered queries and their DuckDB counterparts."""
