"""Readers and writers of archive files, news files, lookups and derived tables."""
