"""Training-data pipeline operators.

Nothing else in ``fieldspark`` imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin query of each.
"""
