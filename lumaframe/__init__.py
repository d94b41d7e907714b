"""Photo, light and place analytics expressed as Spark DataFrame plans."""
