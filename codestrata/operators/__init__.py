"""codestrata.operators"""
