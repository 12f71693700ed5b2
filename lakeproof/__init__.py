"""lakeproof: dataset auditing, split building and classifier evaluation as Spark DataFrame operators."""
