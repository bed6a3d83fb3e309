"""corpuslens: document-corpus analytics as Spark DataFrame, SQL and ML plans."""
