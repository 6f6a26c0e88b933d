"""lodestack: document knowledge-base building and querying as Spark plans."""
