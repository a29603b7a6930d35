"""Relational operators over assertion rows."""
