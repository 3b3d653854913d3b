"""rasterloom: an image-analytics engine on PySpark DataFrames."""
