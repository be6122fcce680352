"""Named queries: views, and the catalogue that is checked against DuckDB."""
