"""Search, topic analytics and data preparation for document archives on Spark."""
