"""barloom: market-feature analytics expressed as Spark DataFrame plans."""
