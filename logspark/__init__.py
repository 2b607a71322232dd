"""Log-lake analytics on PySpark: parse, store, search, summarise, maintain."""
