"""Operators over tensors in long form and over datasets."""
