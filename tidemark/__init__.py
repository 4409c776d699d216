"""tidemark: point-in-time evidence analytics and corpus operators on PySpark."""
