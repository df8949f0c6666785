"""The registered queries: one for each operator, with its SQL."""
