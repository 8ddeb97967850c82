"""Queries, pixel rules and model bundles as documents."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from gridloom.operators.predicate import OPS, PixelRule, Query


def _query(d: dict) -> Query:
    unknown = set(d) - {"field", "op", "value", "high", "mode"}
    if unknown or d.get("op") not in OPS or not isinstance(d.get("field"), str):
        raise ValueError(f"not a query: {d}")
    if d["op"] == "between" and d.get("high") is None:
        raise ValueError(f"between needs two values: {d}")
    return Query(d["field"], d["op"], float(d["value"]), None if d.get("high") is None else float(d["high"]))


def _plain(q: Query) -> dict:
    return {"field": q.field, "op": q.op, "value": q.value} | ({} if q.high is None else {"high": q.high})


def queries_to_json(queries: Iterable[Query]) -> str:
    return json.dumps([_plain(q) for q in queries])


def queries_from_json(text: str) -> list[Query]:
    return [_query(d) for d in json.loads(text)]


def pixel_rules_to_json(rules: Iterable[PixelRule]) -> str:
    return json.dumps([_plain(r.query) | {"mode": "keep" if r.keep else "omit"} for r in rules])


def pixel_rules_from_json(text: str) -> list[PixelRule]:
    found = json.loads(text)
    if any(d.get("mode") not in ("keep", "omit") for d in found):
        raise ValueError("modes are keep and omit")
    return [PixelRule(_query(d), d["mode"] == "keep") for d in found]


def bundle(names: Sequence[str], scope: str, **more) -> str:
    """What a model was trained on, to be kept beside it."""
    return json.dumps({"names": sorted(names), "scope": scope} | more, sort_keys=True)


def mismatch(text: str, names: Sequence[str], scope: str) -> str:
    """Why a table doesn't fit a bundle; empty if it does."""
    b = json.loads(text)
    missing, extra = sorted(set(b["names"]) - set(names)), sorted(set(names) - set(b["names"]))
    out = [f"scope {scope!r} instead of {b['scope']!r}"] if scope != b["scope"] else []
    return "; ".join(out + ([f"missing {missing}"] if missing else []) + ([f"unknown {extra}"] if extra else []))
