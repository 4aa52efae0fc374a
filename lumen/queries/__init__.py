"""The engine's own queries and the SQL they are checked against."""
