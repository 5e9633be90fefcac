"""Cross-sectional factor analytics on PySpark."""
