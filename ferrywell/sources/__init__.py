"""Readers for files, object listings and JDBC tables."""
