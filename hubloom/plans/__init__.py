"""Plans of the hubloom engine."""
