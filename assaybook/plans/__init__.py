"""Shipped queries composed from operators."""
