"""Training-data operators: one module for each, with their registered queries in ``queries``."""
