"""A vocabulary and text analytics library on Spark DataFrames."""
