"""Structured Streaming forms of the ledger, the import slot and the totals."""
