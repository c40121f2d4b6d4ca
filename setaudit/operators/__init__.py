"""The checks, and the table operators they are made of."""
