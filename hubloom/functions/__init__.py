"""Functions of the hubloom engine."""
