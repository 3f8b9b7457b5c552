"""graphloom: graph-augmented retrieval and corpus processing as Spark DataFrame plans."""
