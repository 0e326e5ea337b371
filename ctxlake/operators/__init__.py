"""ctxlake.operators"""
