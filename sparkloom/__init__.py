"""sparkloom: text retrieval and integrity analytics written with Spark DataFrames."""
