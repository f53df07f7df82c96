"""Relational and stateful operators as DataFrame plans."""
