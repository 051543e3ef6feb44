"""Registered queries of the ledger engine."""
