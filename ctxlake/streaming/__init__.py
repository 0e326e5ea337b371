"""ctxlake.streaming"""
