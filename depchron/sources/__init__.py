"""Reading and binding input tables."""
