"""Training-data operators: each numbered operator is a module of its own.

Nothing outside this package imports it; `tickloom.llm.queries` holds the
registered queries and their SQL.
"""
