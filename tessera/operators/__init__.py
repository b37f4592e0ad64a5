"""Operators over governed tables and earlier results."""
