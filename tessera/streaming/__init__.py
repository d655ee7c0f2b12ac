"""Keyed state over arriving documents."""
