"""lexmill: corpus analytics and register queries expressed as Spark DataFrame plans."""
