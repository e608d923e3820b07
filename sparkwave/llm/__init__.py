"""Operators for building training data at corpus scale.  Nothing outside imports this subpackage."""
