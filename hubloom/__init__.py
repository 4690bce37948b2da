"""hubloom: a Spark-first engine for spatial multi-criteria analytics and data preparation."""
