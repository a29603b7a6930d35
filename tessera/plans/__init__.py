"""Presets: grammar, parsing, matching and linting."""
