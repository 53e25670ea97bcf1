"""Operators put together: the medallion jobs, training, and the registered queries."""
