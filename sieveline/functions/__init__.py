"""Column functions. Everything here stays inside one row."""
