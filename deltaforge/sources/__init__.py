"""Readers and writers of tensors."""
