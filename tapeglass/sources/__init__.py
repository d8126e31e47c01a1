"""Readers and adapters that give the domain tables."""
