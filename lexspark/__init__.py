"""lexspark: a Spark-first analytics engine for semi-structured legal documents."""
