"""The query catalogue: every operator bound to the test tables, with its SQL twin."""
