"""Analytics on sequencing reads and their texts, expressed with Spark DataFrames."""
