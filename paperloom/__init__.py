"""Paperloom: document analytics on PySpark, from raw pages to queryable classified records."""
