"""millrace: recognition-quality and corpus analytics on PySpark."""
