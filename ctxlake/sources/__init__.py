"""ctxlake.sources"""
