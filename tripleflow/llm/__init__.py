"""Operators for training data: vectors, term statistics, split overlap, tokenizing, mixing and reading level."""
