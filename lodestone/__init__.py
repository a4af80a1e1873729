"""Document question answering and training-data preparation on PySpark."""
