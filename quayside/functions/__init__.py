"""Column builders: how values of trade paperwork are normalised and compared. No UDFs."""
