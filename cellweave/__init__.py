"""Image-tile and single-cell analytics on Spark DataFrames, with training-data operators beside it."""
