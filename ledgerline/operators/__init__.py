"""DataFrame -> DataFrame operators (validation, sink, ledger, analytics, pages, metrics)."""
