"""A labelled, column-oriented dataframe engine on Spark DataFrames, Column expressions and Catalyst."""
