"""sifter: file-catalog and text-corpus search and analytics on PySpark."""
