"""optlake: build-configuration analytics as Spark DataFrame operators."""
