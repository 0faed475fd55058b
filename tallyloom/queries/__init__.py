"""Registered queries: name -> (callable, SQL or None)."""
