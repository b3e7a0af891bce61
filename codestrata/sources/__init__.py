"""codestrata.sources"""
