"""Shear-wave splitting analytics and training-data operators on Spark DataFrames."""
