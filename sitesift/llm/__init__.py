"""Training-data operators on Spark: ten pipeline operators and the queries
that apply them to the given tables. Nothing outside this package imports it."""
