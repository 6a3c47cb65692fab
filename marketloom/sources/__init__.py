"""Reading archives and tables, writing parts, and planning downloads."""
