"""Job-posting analytics and retrieval as Spark DataFrame operators."""
