"""Market analytics and strategy validation as Spark DataFrame operators."""
