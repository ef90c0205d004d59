"""Column functions: each takes and returns Columns made of Spark builtins, so they work in batch and streaming plans alike."""
