"""Shared column expressions and fixed value lists."""
