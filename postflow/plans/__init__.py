"""Driver query plans: derivations from the given tables plus their SQL oracles."""
