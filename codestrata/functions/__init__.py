"""codestrata.functions"""
