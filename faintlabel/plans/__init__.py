"""Experiments, the query catalogue and its SQL counterparts."""
