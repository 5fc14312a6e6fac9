"""End-to-end plans: batch ingest, readers, and the registered queries."""
