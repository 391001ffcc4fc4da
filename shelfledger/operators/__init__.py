"""Relational and stateful operators over the retail tables."""
