"""Column functions with dataframe semantics. All are native expressions and hold under ANSI mode."""
