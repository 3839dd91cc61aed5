"""Training-data operators: ten numbered operators and their queries.

Nothing outside this subpackage imports it; the repository works without it.
"""
