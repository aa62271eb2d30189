"""Evidence analytics on Spark: declarative rules, catalogues, logs and streams as DataFrames."""
