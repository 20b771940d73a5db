"""Scalar helpers: periods, predicates, units."""
