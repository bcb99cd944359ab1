"""Scalar functions over array columns, with numpy twins."""
