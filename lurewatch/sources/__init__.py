"""Readers of mail, corpora, payloads and cases."""
