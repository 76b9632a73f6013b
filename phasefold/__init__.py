"""Phase-space particle analytics expressed as Spark DataFrame operators."""
