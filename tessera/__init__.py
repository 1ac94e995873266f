"""tessera: keyed records, typed collections and byte-level scalars on Spark DataFrames."""
