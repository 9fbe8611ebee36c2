"""Operators for training-data problems. Nothing outside this subpackage imports it."""
