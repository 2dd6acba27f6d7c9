"""Reading and writing tables, files and collections."""
