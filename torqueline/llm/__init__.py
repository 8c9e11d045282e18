"""Training-data operators: one module per operator, queries in :mod:`torqueline.llm.queries`."""
