"""Evidence-governed knowledge engine expressed as Spark DataFrame plans."""
