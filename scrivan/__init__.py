"""scrivan: document search, analytics and text-data processing as Spark DataFrame plans."""
