"""Registered queries, and what running them needs."""
