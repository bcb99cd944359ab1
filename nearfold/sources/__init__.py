"""Vectors, edges and stored indexes from tables and files."""
