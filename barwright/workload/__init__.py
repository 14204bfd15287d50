"""Market tables derived from the generic benchmark tables, and the queries over them."""
