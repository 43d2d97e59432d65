"""Registered queries, their SQL twins, and helpers that shape physical plans."""
