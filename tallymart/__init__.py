"""Price-comparison analytics and training-data preparation on PySpark."""
