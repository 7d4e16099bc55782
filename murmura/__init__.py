"""murmura: private-retrieval analytics expressed as Spark DataFrame plans."""
