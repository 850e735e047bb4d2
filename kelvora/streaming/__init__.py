"""Session and state operators, as batches and as streams."""
