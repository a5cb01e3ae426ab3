"""Records that differ only in whitespace, letter case, punctuation or field order (problem 3).

Canonical records are range-partitioned and sorted by (hash, key, line), then every
partition scans its adjacent runs comparing full keys. The range includes the line
number, so a run of any length spreads over several partitions; what is left to
settle are the runs at partition edges, one summary row per partition and run.

Null messages, lines that are not JSON and lines whose value is not an object are
no records: they get no row. An empty text is a text; a null text equals only null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUN_NAMES = ["table_name", "line_no", "first_line", "edge"]
RUN_SCHEMA = "table_name string, line_no bigint, first_line bigint, edge string"
_DROP = re.compile(r"[\W_]+")


def folded(text: Column) -> Column:
    """Only the letters and digits of a text, case folded; null stays null."""
    flat = F.lower(F.upper(text))
    return F.regexp_replace(F.regexp_replace(flat, "[^\\p{L}\\p{N}]+", ""), "ß", "ss")


def speaker(role: Column) -> Column:
    """A role without case and blanks."""
    return F.regexp_replace(F.lower(role), "[\\s\\u00a0\\u200b\\ufeff]+", "")


def turns_key(turns: Column, role_field: str, text_field: str) -> Column:
    """Key of an array of turns; null for a null array. Parts are tagged so that null, empty and text differ."""
    one = lambda m: F.concat(
        F.lit("\x01"), F.coalesce(speaker(m[role_field]), F.lit("\x03")),
        F.lit("\x02"), F.coalesce(folded(m[text_field]), F.lit("\x03")),
    )
    return F.array_join(F.transform(turns, one), "")


def _plain(text: str) -> str:
    return _DROP.sub("", text.casefold())


def canonical_json(value: object) -> object:
    """The value with sorted fields, numbers by value and strings by letters and digits."""
    if isinstance(value, dict):
        return {k: canonical_json(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [canonical_json(x) for x in value]
    if isinstance(value, str):
        return "s" + _plain(value)
    if isinstance(value, bool) or value is None:
        return value
    number = value if isinstance(value, Decimal) else Decimal(value)
    return "n" + (format(number.normalize(), "E") if number.is_finite() and number else "0" if number.is_finite() else str(number))


def json_key(raw: str | None) -> str | None:
    """Key of one JSON line, or null where the line holds no JSON object."""
    if raw is None:
        return None
    try:
        value = json.loads(raw, parse_float=Decimal)
        return json.dumps(canonical_json(value), ensure_ascii=False) if isinstance(value, dict) else None
    except (ValueError, ArithmeticError, RecursionError):
        return None


def _json_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = pa.array([json_key(x) for x in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), keys], ["line_no", "key"])


def keyed_chat(df: DataFrame, name: str, turns: str, role: str, text: str) -> DataFrame:
    """(table_name, line_no, key) of the rows that have turns."""
    return df.where(F.col(turns).isNotNull() & (F.size(turns) > 0)).select(
        F.lit(name).alias("table_name"), "line_no", turns_key(F.col(turns), role, text).alias("key")
    )


def keyed_lines(df: DataFrame, name: str) -> DataFrame:
    """(table_name, line_no, key) of the lines that are JSON objects."""
    keys = df.select("line_no", "raw").mapInArrow(_json_keys, "line_no bigint, key string")
    return keys.where("key is not null").select(F.lit(name).alias("table_name"), "line_no", "key")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, table_name, key, line_no) to rows with the first line of their run.

    Rows whose hash is the first or the last of the partition belong to a run that may
    go on elsewhere; they carry the digest of their full key in ``edge``.
    """
    first_h: int | None = None
    held_h: int | None = None
    held: list[tuple[str, str, list[int]]] = []  # runs of the hash at hand: table, key, lines in order

    def release(edge: bool) -> Iterator[pa.RecordBatch]:
        for name, key, lines in held:
            mark = f"{held_h}:{name}:" + hashlib.sha256(key.encode()).hexdigest() if edge else None
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array(lines, pa.int64()), pa.array(np.full(n, lines[0], np.int64)), pa.array([mark] * n, pa.string())],
                _RUN_NAMES,
            )
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy(zero_copy_only=False)
        first_h = int(h[0]) if first_h is None else first_h
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.append(starts[1:], len(h))
        plain = ends - starts == 1
        plain[0] = plain[-1] = False
        if at := starts[plain].tolist():
            part = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(3), part.column(3), pa.nulls(len(at), pa.string())], _RUN_NAMES)
        for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True):
            here = int(h[s])
            if held_h is not None and here != held_h:
                yield from release(held_h == first_h)
            held_h = here
            group = b.slice(s, e - s)
            for name, key, line in zip(group.column(1).to_pylist(), group.column(2).to_pylist(), group.column(3).to_pylist(), strict=True):
                if not held or held[-1][0] != name or held[-1][1] != key:
                    held.append((name, key, []))
                held[-1][2].append(line)
    yield from release(True)


def runs(keyed: DataFrame, partitions: int | None = None) -> DataFrame:
    """(table_name, line_no, first_line) of every keyed row: first_line is the lowest line with an equal key.

    ``keyed`` has table_name, line_no and key. Repeated rows keep their repeats.
    """
    n = partitions or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        keyed.select(F.xxhash64("table_name", "key").alias("h"), "table_name", "key", "line_no")
        .repartitionByRange(n, "h", "line_no")
        .sortWithinPartitions("h", "table_name", "key", "line_no")
    )
    scanned = ordered.mapInArrow(_scan, RUN_SCHEMA)
    # At most the runs of two hash values in each partition reach this aggregate, so it is broadcast.
    edges = scanned.where("edge is not null").groupBy("edge").agg(F.min("first_line").alias("edge_first"))
    return scanned.join(F.broadcast(edges), "edge", "left").select("table_name", "line_no", F.coalesce("edge_first", "first_line").alias("first_line"))


def collapsed(assigned: DataFrame) -> DataFrame:
    """One row for each kind of record with its exact number of copies."""
    return assigned.groupBy("table_name", F.col("first_line").alias("line_no")).agg(F.count("*").alias("copies"))


def copies(assigned: DataFrame) -> DataFrame:
    """(table_name, line_a, line_b): every row that repeats an earlier one."""
    return assigned.where("line_no <> first_line").select("table_name", F.col("first_line").alias("line_a"), F.col("line_no").alias("line_b")).distinct()
