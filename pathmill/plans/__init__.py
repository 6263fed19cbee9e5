"""The entity model, path queries on it, and the views that answer them."""
