"""Sources of the hubloom engine."""
