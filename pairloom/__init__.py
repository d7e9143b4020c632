"""Pair-corpus analytics and vocabulary discovery on Spark DataFrames."""
