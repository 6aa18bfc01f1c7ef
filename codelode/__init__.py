"""codelode: source-code and text analytics as Spark DataFrame operators."""
