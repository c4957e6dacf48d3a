"""visitloom: web and e-commerce analytics operators on PySpark DataFrames."""
