"""Readers of media files as rows, and writers; files come and go through Spark's own or registered data sources."""
