"""Operators on message and ticket tables."""
