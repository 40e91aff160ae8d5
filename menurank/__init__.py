"""menurank: explainable content-based ranking on PySpark."""
