"""Point-in-time forecasts over threshold ladders, built and scored as Spark DataFrame plans."""
