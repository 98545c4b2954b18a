"""papyrix: text-corpus analytics expressed as PySpark plans."""
