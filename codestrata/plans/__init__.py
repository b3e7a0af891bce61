"""codestrata.plans"""
