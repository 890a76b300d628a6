"""Operators for preparing language-model training data. Nothing else in waymark imports this subpackage."""
