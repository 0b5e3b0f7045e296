"""Moving tables into an analytics store with Spark, and proving that they arrived intact."""
