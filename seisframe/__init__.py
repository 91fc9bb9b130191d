"""SEG-Y surveys as Spark DataFrames."""
