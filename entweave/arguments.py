"""Checks of what callers pass in: language lists, id lists, identifiers, byte sizes, merged settings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from pathlib import Path

_LANGUAGE = re.compile(r"[a-z][a-z0-9-]*")
_QID, _ENTITY = re.compile(r"Q[1-9][0-9]*"), re.compile(r"[QP][1-9][0-9]*")
_NAME = re.compile(r"[^\W\d]\w*", re.ASCII)


def _each(raw: str, fold: Callable[[str], str], ok: re.Pattern, complaint: str) -> list[str]:
    """Distinct items of a list separated by commas or line ends, in order."""
    items = [fold(x.strip()) for x in re.split(r"[,\n]", raw)]
    wrong = next((x for x in items if x and not ok.fullmatch(x)), None)
    if wrong is not None:
        raise ValueError(f"{complaint}: {wrong!r}")
    return list(dict.fromkeys(x for x in items if x))


def languages(raw: str) -> list[str]:
    found = _each(raw.replace("\n", " "), str.casefold, _LANGUAGE, "not a language code")
    if not found:
        raise ValueError("at least one language code is needed")
    return found


def item_ids(raw: str) -> list[str]:
    """Q ids, in any case."""
    return _each(raw, str.upper, _QID, "not a Q id")


def entity_ids(raw: str) -> list[str]:
    """Q and P ids, as they are written."""
    return _each(raw, str, _ENTITY, "not an entity id")


def ids_of_file(path: str, parse: Callable[[str], list[str]] = item_ids) -> list[str]:
    """One or several ids to a line; blank lines and those that begin with # are passed over."""
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    return parse(",".join(x for x in lines if x and not x.startswith("#")))


def one_selector(**given: object) -> str:
    """The name of the only argument that is set."""
    named = [k for k, v in given.items() if v not in (None, "", [])]
    if len(named) != 1:
        raise ValueError(f"exactly one of {', '.join(given)} is needed")
    return named[0]


def identifier(name: str) -> str:
    """A column or table name that may be put into SQL text; parts may be joined by dots."""
    parts = name.strip().split(".")
    if not all(_NAME.fullmatch(p) for p in parts):
        raise ValueError(f"not an identifier: {name!r}")
    return ".".join(parts)


def first_existing(paths: Iterable[Path]) -> Path:
    tried = list(paths)
    found = next((p for p in tried if p.exists()), None)
    if found is None:
        raise FileNotFoundError(f"none of these exist: {', '.join(map(str, tried))}")
    return found


def merged(base: dict, override: dict) -> dict:
    """override wins; where both hold a mapping these are merged in turn."""
    both = {k: merged(base[k], override[k]) for k in base.keys() & override.keys() if isinstance(base[k], dict) and isinstance(override[k], dict)}
    return {**base, **override, **both}
