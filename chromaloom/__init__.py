"""chromaloom: chromosome-contact analytics on Spark DataFrames."""
