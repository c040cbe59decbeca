"""Inputs, queries and oracles that check the engine on the given tables."""
