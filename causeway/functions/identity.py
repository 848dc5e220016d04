"""Content-hashed identities and canonical JSON."""

from __future__ import annotations

import hashlib
import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from causeway.functions.schema import PROVENANCE

_INDEX = re.compile(r"0|[1-9]\d{0,9}")


def _number(x: float) -> str:
    """A JSON number the way ECMAScript prints it."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("numbers must be finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(float(x))
    digits, _, exp = text.partition("e")
    if not exp:
        return text
    power = int(exp)
    if -7 < power < 0:  # ECMAScript writes 0.000001 in full
        sign, body = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
        return f"{sign}0.{'0' * (-power - 1)}{body.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{power:+d}"


def _key_order(key: str) -> tuple:
    """Array indices come first, as numbers; the rest by UTF-16 code units."""
    if _INDEX.fullmatch(key) and int(key) < (1 << 32) - 1:
        return (0, int(key), b"")
    return (1, 0, key.encode("utf-16-be", "surrogatepass"))


def canonical_json(value: Any) -> str:
    """Sorted keys, no white space, non-ASCII left as it is."""
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise ValueError("keys must be strings")
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=_key_order)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        return _number(value)
    raise ValueError(f"{type(value).__name__} is not JSON")


@F.pandas_udf(StringType())
def canonical_metadata(text: pd.Series) -> pd.Series:
    """Canonical form of a JSON text column; null stays null."""
    return text.map(lambda t: None if t is None else canonical_json(json.loads(t)), na_action="ignore")


def node_id(namespace: Column | str, kind: Column | str, key: Column | str) -> Column:
    c = [F.col(x) if isinstance(x, str) else x for x in (key, kind, namespace)]
    return _id("node:", F.struct(c[0].alias("key"), c[1].alias("kind"), c[2].alias("namespace")))


def _id(prefix: str, value: Column) -> Column:
    """Never null, which Spark is told, lest joins hash a second time to test it."""
    return F.coalesce(F.concat(F.lit(prefix), F.sha2(F.to_json(value), 256)), F.lit(""))


def edge_id(kind: Column | str, src: Column | str, dst: Column | str, edge_key: Column | str | None = None) -> Column:
    """A null key does not take part."""
    kind, src, dst = (F.col(x) if isinstance(x, str) else x for x in (kind, src, dst))
    key = F.lit(None).cast("string") if edge_key is None else F.col(edge_key) if isinstance(edge_key, str) else edge_key
    return _id("edge:", F.struct(src.alias("from"), key.alias("key"), kind.alias("kind"), dst.alias("to")))


#: What ids are but their hash, in the order of the texts; ``packed`` writes a byte for it.
_PACKED = {"edge:": b"\x01", "node:": b"\x02"}


def packed(id_: Column | str) -> Column:
    """An id in 33 bytes, for what is sorted, shuffled or stored; other texts whole
    behind a zero byte. Null stays null."""
    c = F.col(id_) if isinstance(id_, str) else id_
    mark = F.when(c.startswith("edge:"), F.lit(_PACKED["edge:"])).otherwise(F.lit(_PACKED["node:"]))
    whole = F.concat(F.lit(b"\x00"), c.cast("binary"))
    return F.when(c.rlike(r"^(?:edge|node):[0-9a-f]{64}\z"), F.concat(mark, F.unhex(F.substring(c, 6, 64)))).otherwise(whole)


def unpacked(id_: Column | str) -> Column:
    """The text of a ``packed`` id."""
    c = F.col(id_) if isinstance(id_, str) else id_
    mark, rest = F.substring(c, 1, 1), F.substring(c, 2, (1 << 31) - 1)
    out = F.when(mark == F.lit(b"\x00"), rest.cast("string"))
    for prefix, byte in _PACKED.items():
        out = out.when(mark == F.lit(byte), F.concat(F.lit(prefix), F.lower(F.hex(rest))))
    return out


def is_whole(id_: Column) -> Column:
    """Whether a ``packed`` id stands whole; without such ones, packed ids have the order of their texts."""
    return F.substring(id_, 1, 1) == F.lit(b"\x00")


def node_id_of(namespace: str, kind: str, key: str) -> str:
    """``node_id`` of plain strings, for the driver."""
    return "node:" + hashlib.sha256(canonical_json({"namespace": namespace, "kind": kind, "key": key}).encode()).hexdigest()


def keyed_hash(prefix: str, value: Any) -> str:
    """An address such as ``artifact-sha256-...`` of a plain value."""
    return prefix + hashlib.sha256(canonical_json(value).encode()).hexdigest()


def coordinate_key(kind: Column, ecosystem: Column, name: Column, version: Column) -> Column:
    return F.to_json(F.struct(ecosystem.alias("ecosystem"), kind.alias("kind"), name.alias("name"), version.alias("version")))


def provenance(**fields: Column | str | None) -> Column:
    """A provenance struct; what is not given is absent."""

    def value(name: str, kind) -> Column:
        v = fields.get(name)
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name)

    return F.struct(*[value(f.name, f.dataType) for f in PROVENANCE.fields])


def evidence(**fields: Column | str | None) -> Column:
    return F.array(provenance(**fields))
