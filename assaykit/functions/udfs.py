"""Arrow functions for what Spark has no expression for: full case folding, canonical JSON, beta quantiles, JSON Schema.

Each is a small per-value helper in a vectorised UDF; all rows stay partitioned as they are.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F


def fold_text(s: str | None) -> str | None:
    """NFKC, full case folding, white space collapsed."""
    return None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split())


class _Duplicate(ValueError):
    pass


def _no_duplicates(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Duplicate("duplicate key")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def strict_json(s: str):
    """Parses JSON; duplicate keys, NaN and infinities are errors."""
    return json.loads(s, object_pairs_hook=_no_duplicates, parse_constant=_no_constant)


def canonical(value) -> str:
    """Keys sorted, no spaces, no escapes beyond the needed; 1 and 1.0 differ."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_text(s: str | None) -> str | None:
    """Null for what is not strict JSON."""
    if s is None:
        return None
    try:
        return canonical(strict_json(s))
    except ValueError:
        return None


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = tiny, tiny, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_tail(mid, a, b) < q else (low, mid)
    return (low + high) / 2


_TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and float(v).is_integer(),
}


def schema_errors(value, schema, at: str = "$") -> list[str]:
    """Violations of the JSON Schema keywords in use: type, enum, const, bounds, lengths, pattern, items, properties,
    required, additionalProperties, allOf, anyOf, oneOf, not."""
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [f"{at}: nothing is allowed"]
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None and not any(_TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: is not {kinds}"]
    same = lambda a, b: canonical(a) == canonical(b)
    if "enum" in schema and not any(same(value, e) for e in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: is not the constant")
    if _TYPES["number"](value):
        for key, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            if key in schema and bad(value, schema[key]):
                out.append(f"{at}: breaks {key}")
    for key, kind in (("Length", str), ("Items", list), ("Properties", dict)):
        if isinstance(value, kind):
            if len(value) < schema.get(f"min{key}", 0):
                out.append(f"{at}: breaks min{key}")
            if len(value) > schema.get(f"max{key}", math.inf):
                out.append(f"{at}: breaks max{key}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: breaks pattern")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: lacks {k}" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            out += schema_errors(x, known[k] if k in known else schema.get("additionalProperties", True), f"{at}.{k}")
    for s in schema.get("allOf", []):
        out += schema_errors(value, s, at)
    if "anyOf" in schema and all(schema_errors(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: breaks anyOf")
    if "oneOf" in schema and sum(not schema_errors(value, s, at) for s in schema["oneOf"]) != 1:
        out.append(f"{at}: breaks oneOf")
    if "not" in schema and not schema_errors(value, schema["not"], at):
        out.append(f"{at}: breaks not")
    return out


#: Field names that hold secrets.
SENSITIVE_KEY = re.compile(r"(authorization|api[-_]?key|x-api-key|access[-_]?token|secret|password|cookie)", re.I)
MASK = "[REDACTED]"


def _empty(v) -> bool:
    """What needs no mask: null, and empty texts, lists and objects; 0 and false are values."""
    return v is None or isinstance(v, str | list | dict) and not v


def redact(value, secrets: list[str] = ()):
    """(copy without secrets, number of redactions): fields with telling names, and known secret values, longest first."""
    known = re.compile("|".join(re.escape(s) for s in sorted(filter(None, secrets), key=len, reverse=True)) or r"(?!)")

    def clean(v) -> tuple:
        if isinstance(v, str):
            return known.subn(MASK, v)
        if isinstance(v, list):
            done = [clean(x) for x in v]
            return [x for x, _ in done], sum(n for _, n in done)
        if isinstance(v, dict):
            done = {k: (MASK, 1) if not _empty(x) and SENSITIVE_KEY.search(k) else clean(x) for k, x in v.items()}
            return {k: x for k, (x, _) in done.items()}, sum(n for _, n in done.values())
        return v, 0

    return clean(value)


def canonical_json():
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(canonical_text, na_action="ignore")

    return f


def credible_interval(confidence: float = 0.95):
    """Equal-tailed interval of a beta posterior: struct<low, high>, from its two parameters."""
    tail = (1 - confidence) / 2

    @F.pandas_udf("low double, high double")
    def f(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict = {}
        for pair in set(zip(a, b, strict=True)):
            known[pair] = (beta_quantile(tail, *pair), beta_quantile(1 - tail, *pair))
        return pd.DataFrame([known[p] for p in zip(a, b, strict=True)], columns=["low", "high"])

    return f


class Schemas(dict):
    """Schemas by their text, each read once in the life of a Python worker, told apart by the text; emptied when full."""

    LIMIT = 10_000

    def __missing__(self, text: str):
        if len(self) >= self.LIMIT:
            self.clear()
        self[text] = found = strict_json(text)
        return found


_SCHEMAS = Schemas()


def violations_by(value: str | None, schema: str | None) -> list[str] | None:
    """Violations of a JSON text by a schema given as JSON text; null for either is null. Text that is not strict JSON is one
    violation; a schema that can't be read or applied is one that begins with ``schema:``."""
    if value is None or schema is None:
        return None
    try:
        rules = _SCHEMAS[schema]
    except ValueError as e:
        return [f"schema: {e}"]
    try:
        got = strict_json(value)
    except ValueError as e:
        return [f"$: {e}"]
    try:
        return schema_errors(got, rules)
    except (KeyError, TypeError, AttributeError, re.error) as e:
        return [f"schema: {type(e).__name__} {e}"]


def matches_schema(schema: dict | None = None):
    """Array of violations of a JSON text, by one schema for all rows, or by a second column of schemas as JSON text."""
    if schema is not None:
        fixed = json.dumps(schema)

        @F.pandas_udf("array<string>")
        def f(s: pd.Series) -> pd.Series:
            return s.map(lambda x: violations_by(x, fixed), na_action="ignore")

        return f

    @F.pandas_udf("array<string>")
    def by_row(s: pd.Series, schemas: pd.Series) -> pd.Series:
        return pd.Series([violations_by(x, y) for x, y in zip(s, schemas, strict=True)], dtype=object)

    return by_row


def argument_errors():
    """For each call's arguments its violations, joined by '; ', of the schema in the same place: '' if there is none, null without
    a schema, which is a tool without a contract. Missing arguments and empty schemas are {}."""

    def of(arguments, schemas):
        return None if arguments is None else [None if s is None else "; ".join(violations_by(a or "{}", s or "{}")) for a, s in zip(arguments, schemas, strict=True)]

    @F.pandas_udf("array<string>")
    def f(arguments: pd.Series, schemas: pd.Series) -> pd.Series:
        return pd.Series([of(a, s) for a, s in zip(arguments, schemas, strict=True)], dtype=object)

    return f


def unequal_fields():
    """How many of the wanted fields (map of name to JSON text) a JSON object lacks or has with another value, by canonical
    JSON, in which 1 and 1.0 differ; null for what is no JSON object."""

    def count(text, wanted):
        try:
            got = strict_json(text or "")
        except ValueError:
            return None
        if not isinstance(got, dict):
            return None
        return sum(k not in got or canonical(got[k]) != canonical_text(v) for k, v in dict(wanted or ()).items())

    @F.pandas_udf("int")
    def f(s: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([count(x, w) for x, w in zip(s, wanted, strict=True)], dtype="Int32")

    return f


def redacted(secrets: list[str] = ()):
    """struct<text, n> of a JSON text."""

    @F.pandas_udf("text string, n int")
    def f(s: pd.Series) -> pd.DataFrame:
        rows = [(None, 0) if x is None else (lambda v: (canonical(v[0]), v[1]))(redact(json.loads(x), list(secrets))) for x in s]
        return pd.DataFrame(rows, columns=["text", "n"])

    return f
