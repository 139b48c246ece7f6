"""assayer: code-quality analytics as Spark DataFrame queries."""
