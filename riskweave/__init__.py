"""riskweave: point-in-time transfer-risk analytics on Spark DataFrames."""
