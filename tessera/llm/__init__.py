"""Training-data operators: one module per operator, ``queries`` for their registration."""
