"""Where tables and settings come from."""
