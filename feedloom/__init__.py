"""Feed curation and run analytics as plain PySpark DataFrame operators."""
