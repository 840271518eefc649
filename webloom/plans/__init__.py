"""Named queries over a folder of Parquet tables, and the SQL that gives the same rows."""
