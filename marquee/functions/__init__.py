"""Column-expression builders (pure ``pyspark.sql.functions`` compositions,
JVM-side, no Python UDFs)."""
