"""Session, conversation and repository analytics as Spark DataFrame jobs."""
