"""Tensor-file analytics and training-data operators on PySpark."""
