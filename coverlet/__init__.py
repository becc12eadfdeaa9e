"""Document coverage analytics on Spark."""
