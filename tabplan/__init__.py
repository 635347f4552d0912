"""tabplan: typed table plans compiled to lazy Spark DataFrames."""
