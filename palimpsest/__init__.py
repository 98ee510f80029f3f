"""Rule-driven record-to-document analytics on PySpark."""
