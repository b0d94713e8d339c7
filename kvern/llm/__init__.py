"""Operators for training data. Nothing else in kvern imports this subpackage."""
