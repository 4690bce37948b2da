"""Operators for language-model data and their queries. Nothing outside this package imports it."""
