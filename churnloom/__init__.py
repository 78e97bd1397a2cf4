"""Customer-churn analytics as Spark DataFrame operators and Spark ML stages."""
