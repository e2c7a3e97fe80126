"""Daily equity-panel factor research expressed as Spark DataFrame plans."""
