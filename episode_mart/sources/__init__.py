"""Readers and writers: folders of CSV and workbook files, Parquet tables, load manifest."""
