"""Structural diff, patch and merge of trees at collection scale, on Spark DataFrames."""
