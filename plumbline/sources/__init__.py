"""Readers and writers of capture formats. Files are read by Spark's own readers, so any store that Spark reaches works."""
