"""Readers and writers of rasters, tables and documents."""
