"""Evidence analytics on Spark: statistical tables and documents as DataFrames."""
