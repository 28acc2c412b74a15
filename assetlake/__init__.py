"""AssetLake: file-catalog analytics as PySpark DataFrame operators."""
