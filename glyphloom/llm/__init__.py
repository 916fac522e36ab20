"""Training-data operators: language, scoring, counting, dedup, mixing, safety.

Nothing outside this subpackage imports it.
"""
