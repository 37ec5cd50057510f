"""textloom: text and vector analytics expressed as Spark DataFrame plans."""
