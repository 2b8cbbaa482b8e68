"""DataFrame operators. Each keeps the row key (``row_id``) and returns a DataFrame."""
