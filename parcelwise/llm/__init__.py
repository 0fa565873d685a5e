"""Training-data operators: dedup, mixing, language, privacy, search, archives, packing.

Nothing outside this folder imports it; ``queries.py`` lists its registered queries.
"""
