"""codexmill: a Spark-first analytics engine for legal text corpora."""
