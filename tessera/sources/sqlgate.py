"""The gate for user SQL on SQLite: one SELECT that cannot write, attach or load anything."""

from __future__ import annotations

import re
import sqlite3

# Words that no query may hold outside strings and comments.
FORBIDDEN = [
    "ALTER", "ANALYZE", "ATTACH", "BEGIN", "COMMIT", "CREATE", "DELETE", "DETACH", "DROP", "END", "INSERT", "PRAGMA",
    "REINDEX", "RELEASE", "REPLACE", "ROLLBACK", "SAVEPOINT", "UPDATE", "VACUUM",
]
_READ = {sqlite3.SQLITE_SELECT, sqlite3.SQLITE_READ, sqlite3.SQLITE_FUNCTION, sqlite3.SQLITE_RECURSIVE}


class UnsafeSql(ValueError):
    """SQL that the gate does not let through."""


def _bare(sql: str) -> str:
    """The query with strings, quoted names and comments blanked out."""
    return re.sub(r"--[^\n]*|/\*.*?(?:\*/|$)|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\]|`[^`]*`", " ", sql, flags=re.S)


def check_sql(sql: str) -> str:
    """The query, if it is one SELECT (or WITH ... SELECT) without aliases and forbidden words."""
    bare = _bare(sql).strip()
    if not bare:
        raise UnsafeSql("an empty query")
    if ";" in bare.rstrip(";").rstrip() or bare.endswith(";"):
        raise UnsafeSql("a query must be one statement without ';'")
    if not re.match(r"(?i)(select|with)\b", bare):
        raise UnsafeSql("a query must start with SELECT")
    for word in FORBIDDEN:
        if word == "END" and re.search(r"(?i)\bcase\b", bare):
            continue
        if word == "REPLACE" and re.search(r"(?i)\breplace\s*\(", bare):
            continue
        if re.search(rf"(?i)\b{word}\b", bare):
            raise UnsafeSql(f"{word} is not allowed in a query")
    if re.search(r"(?i)\bas\b", re.sub(r"(?i)\bcast\s*\([^()]*\)", " ", bare)) and not re.match(r"(?i)with\b", bare):
        raise UnsafeSql("columns keep the names of their tables: AS is not allowed")
    return sql


def quoted(name: str) -> str:
    """A name as an SQL identifier."""
    if not name or '"' in name or any(ord(c) < 32 or ord(c) == 127 for c in name):
        raise UnsafeSql(f"{name!r} cannot be a name")
    return f'"{name}"'


def connect(path: str, immutable: bool) -> sqlite3.Connection:
    """A read-only connection on which nothing but reading is authorised."""
    from urllib.parse import quote

    db = sqlite3.connect(f"file:{quote(path)}?mode=ro{'&immutable=1' if immutable else ''}", uri=True)
    db.text_factory = lambda raw: raw.decode("utf-8", "replace")
    db.execute("PRAGMA query_only = 1")
    db.execute("PRAGMA trusted_schema = 0")
    db.set_authorizer(lambda action, *_: sqlite3.SQLITE_OK if action in _READ or action == sqlite3.SQLITE_PRAGMA else sqlite3.SQLITE_DENY)
    return db
