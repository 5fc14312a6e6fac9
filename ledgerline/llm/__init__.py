"""Operators for large training-data pipelines. Nothing else imports this."""
