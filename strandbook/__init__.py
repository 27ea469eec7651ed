"""Session-ledger analytics on Spark DataFrames."""
