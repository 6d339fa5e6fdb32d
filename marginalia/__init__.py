"""Evidence-licensed text-relation analytics as Spark DataFrame plans."""
