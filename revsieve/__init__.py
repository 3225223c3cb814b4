"""Pull-request review analytics as Spark DataFrame operators."""
