"""Relational operators over long panels."""
