"""Algebra of job documents: merging, projecting, cleaning, importing and inheriting JSON objects."""

from __future__ import annotations

import json
import os
from copy import deepcopy

from readloom.functions.tokens import PlanError


def merge(base: dict, child: dict) -> dict:
    """child with the keys of base that it lacks; objects merge key by key, anything else of child stands. An object against something else is an error."""
    out = dict(child)
    for key, value in base.items():
        if key not in out:
            out[key] = deepcopy(value)
        elif isinstance(value, dict) != isinstance(out[key], dict):
            raise PlanError(f"{key!r} is an object on one side only")
        elif isinstance(value, dict):
            out[key] = merge(value, out[key])
    return out


def overlay(over: dict, base: dict) -> dict:
    """base with over on top of it."""
    return merge(base, over)


def project(template: dict, source: dict) -> dict:
    """The keys of template, filled from source, else with the template's value; arrays of objects element by element."""
    out = {}
    for key, default in template.items():
        value = source.get(key)
        if isinstance(default, dict) and isinstance(value, dict):
            out[key] = project(default, value)
        elif isinstance(default, list) and isinstance(value, list) and default and isinstance(default[0], dict):
            out[key] = [project(default[0], v) if isinstance(v, dict) else v for v in value]
        else:
            out[key] = deepcopy(default if value is None else value)
    return out


def clean(value):
    """Without nulls, false, and empty strings, arrays and objects; null if nothing is left."""
    if isinstance(value, dict):
        value = {k: c for k, v in value.items() if (c := clean(v)) is not None}
    elif isinstance(value, list):
        value = [c for v in value if (c := clean(v)) is not None]
    return None if value is None or value is False or value in ("", [], {}) and not isinstance(value, (int, float)) else value


def sort_keys(value):
    if isinstance(value, dict):
        return {k: sort_keys(value[k]) for k in sorted(value)}
    return [sort_keys(v) for v in value] if isinstance(value, list) else value


def remove_disabled(value):
    """Without the objects that say `disabled: true`."""
    gone = lambda v: isinstance(v, dict) and v.get("disabled") is True
    if isinstance(value, dict):
        return {k: remove_disabled(v) for k, v in value.items() if not gone(v)}
    return [remove_disabled(v) for v in value if not gone(v)] if isinstance(value, list) else value


def load(path: str, _seen: set[str] | None = None) -> dict:
    """A job document with its imports: depth first, relative to the importing file, each file once; later ones override earlier ones, the document itself all of them."""
    seen = set() if _seen is None else _seen
    where = os.path.realpath(path)
    seen.add(where)
    with open(where, encoding="utf-8") as file:
        document = json.load(file)
    imported: dict = {}
    for other in document.pop("import", []):
        target = os.path.realpath(os.path.join(os.path.dirname(where), os.path.expandvars(os.path.expanduser(other))))
        if target not in seen:
            imported = overlay(load(target, seen), imported)
    return overlay(document, imported)


def inherit(repository: dict[str, dict], name: str, _chain: tuple[str, ...] = ()) -> dict:
    """A decoder of the repository with what its chain of bases gives it."""
    if name not in repository:
        raise PlanError(f"unknown base decoder {name!r}")
    if name in _chain:
        raise PlanError(f"decoder {name!r} is its own base")
    decoder = dict(repository[name])
    base = decoder.pop("base", None)
    return decoder if base is None else overlay(decoder, inherit(repository, base, (*_chain, name)))
