"""Operators of the hubloom engine."""
