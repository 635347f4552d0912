"""The plan language: specification, relations and the compiler to lazy DataFrames."""
