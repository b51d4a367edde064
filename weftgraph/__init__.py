"""Property graphs on Spark: typed vertices and attributed edges held as DataFrames."""
