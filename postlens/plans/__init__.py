"""Research plans as tables, and the end-to-end flows."""
