"""Scalar expressions, text similarity and evaluation metrics."""
