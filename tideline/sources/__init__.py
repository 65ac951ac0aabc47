"""Readers: JSON, Parquet lake, CSV, whole files, JDBC and tick streams."""
