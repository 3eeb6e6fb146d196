"""typeloom: text-correction and training-data analytics on Spark DataFrames."""

__all__ = ["tables"]
