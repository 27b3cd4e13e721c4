"""Evidence-first search and analytics over business documents, on Spark."""
