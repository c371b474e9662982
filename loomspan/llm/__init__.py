"""Training-data operators: one module per operator, plus ``queries`` and ``sql``.

Nothing outside this subpackage imports it.
"""
