"""Raw records to typed tables, and table readers and writers."""
