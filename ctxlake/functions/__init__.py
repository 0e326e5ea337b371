"""ctxlake.functions"""
