""". of the batch document question-answering engine."""
