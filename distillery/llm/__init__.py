"""Training-data operators: one module each, with thin contract queries in ``queries``."""
