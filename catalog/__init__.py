"""The registered queries and their SQL oracles, by inventory id."""
