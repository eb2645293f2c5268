"""Operators that prepare text corpora for training language models; every operator is a function on DataFrames."""
