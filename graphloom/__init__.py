"""graphloom: corpus-to-graph analytics on PySpark DataFrames."""
