"""Reading and writing: diff files, the revision table, query and trend files."""
