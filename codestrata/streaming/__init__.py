"""codestrata.streaming"""
