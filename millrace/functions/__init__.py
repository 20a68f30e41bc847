"""Types of the dialect and the functions and predicates over them, as Spark columns."""
