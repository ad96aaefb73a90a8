"""DataFrame → DataFrame operators (see README for the inventory map)."""
