"""arborfold: versioned, mergeable tables and entry graphs as Spark DataFrames."""
