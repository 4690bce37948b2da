"""Streaming of the hubloom engine."""
