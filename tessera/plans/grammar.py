"""The small languages of presets: references to values, and pipes of steps."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Kinds of reference and the arguments that some kinds are limited to.
KINDS = ["column", "header", "filename", "const", "param", "preset"]
LIMITED = {
    "filename": ["name", "stem", "path"],
    "param": ["entity", "linked_entity"],
    "preset": ["path", "name", "format", "table", "sheet", "sql", "id", "tier", "os", "tool", "version", "os_version"],
}
_CALL = re.compile(r"^\s*([A-Za-z_]\w*)\s*(?:\((.*)\))?\s*$", re.S)


@dataclass(frozen=True)
class Ref:
    kind: str
    arg: object

    @property
    def is_glob(self) -> bool:
        return self.kind in ("column", "header") and any(c in str(self.arg) for c in "*?[")


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple = ()
    options: dict = field(default_factory=dict)


def scalar(text: str) -> object:
    """A quoted string, null, a truth value, a number, or the bare word."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.lower() in ("null", "none", ""):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_ref(text: object) -> Ref:
    """`kind(argument)`."""
    found = _CALL.match(text) if isinstance(text, str) else None
    if not found or found[2] is None or found[1] not in KINDS:
        raise ValueError(f"{text!r} is not a reference; expected one of {', '.join(f'{k}(...)' for k in KINDS)}")
    kind, arg = found[1], found[2].strip()
    if kind == "const":
        return Ref(kind, scalar(arg))
    if len(arg) >= 2 and arg[0] == arg[-1] and arg[0] in "'\"":
        arg = arg[1:-1]
    if not arg:
        raise ValueError(f"{text!r} has no argument")
    if arg not in LIMITED.get(kind, [arg]):
        raise ValueError(f"{text!r}: expected one of {', '.join(LIMITED[kind])}")
    return Ref(kind, arg)


def cut(text: str, mark: str) -> list[str]:
    """Split at a mark that stands outside quotes and parentheses."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == mark and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    if quote or depth:
        raise ValueError(f"unbalanced quotes or parentheses in {text!r}")
    return [*parts, text[start:]]


def parse_pipe(text: object) -> tuple[Step, ...]:
    """Steps `name` or `name(arguments)` joined by `|`; `key=value` arguments are options."""
    if text is None:
        return ()
    steps = []
    for part in cut(str(text), "|"):
        found = _CALL.match(part)
        if not found:
            raise ValueError(f"{part.strip()!r} is not a pipe step")
        name, body, args, options = found[1], found[2], [], {}
        for item in cut(body, ",") if body and body.strip() else []:
            option = re.match(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.*)$", item, re.S)
            if option:
                options[option[1]] = scalar(option[2])
            elif name == "arithmetic":  # the expression as written, quoted or not
                args.append(str(scalar(item)) if item.strip()[:1] in "'\"" else item.strip())
            else:
                args.append(scalar(item))
        steps.append(Step(name, tuple(args), options))
    return tuple(steps)
