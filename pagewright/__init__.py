"""Page-level retrieval analytics as lazy Spark DataFrame plans."""
