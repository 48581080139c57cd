"""Structured Streaming forms of the shop's reactive logic (cart changes and
the three triggers), built from the same functions as the batch queries."""
