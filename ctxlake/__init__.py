"""ctxlake: a PySpark engine that turns documents, logs and session events into compact, token-budgeted context."""
