"""Operators for building training data at scale; nothing else imports this part."""
