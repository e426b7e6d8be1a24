"""Network-flow attack analytics expressed as Spark DataFrame operators."""
