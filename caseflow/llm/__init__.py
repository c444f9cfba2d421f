"""Training-data operators: packing, token files, vector search, text scans.

Nothing else in the library imports this subpackage; ``queries.py`` registers
one query per operator and ``sql.py`` holds the DuckDB oracles.
"""
