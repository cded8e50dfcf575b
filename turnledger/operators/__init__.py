"""Relational operators over sessions, turns, claims and facts."""
