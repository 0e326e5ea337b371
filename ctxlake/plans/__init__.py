"""ctxlake.plans"""
