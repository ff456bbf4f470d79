"""Line deduplication by a deletion-neighbourhood join.

A line (a piece of a text between line feeds, blank ones aside) goes if an
equal line stands earlier in the corpus, or if an earlier line is at most
``edits`` edits away: characters changed, added or removed.  Earlier means a
smaller doc_id (null first; ties: md5 of the row), then a smaller line number.
Lines under ``shortest`` characters are compared for equality only.

Equal lines are reduced to their first occurrence.  Two lines e edits apart
match one pattern of at most e marks, each of which stands for one character
or none.  A line of n characters enters patterns of length L = n .. n + e
(L - n of its marks stand for none), which are cut into m parts:

- with m = e + 1 some part has no mark.  A line that shares no part, at a
  fitting place, with another line has no neighbour; this settles nearly all
  lines;
- the others emit a key for every choice of e of m parts, the hash of all else
  in the pattern: lines within e edits share one.  Groups of at most ``PAIRS``
  lines are compared pair by pair;
- a larger group is cut again, m times ``PARTS``, within its chosen parts.
  Once a part is one character, all lines of a key are neighbours of its
  earliest one, so no group needs more pairs than ``PAIRS`` allows.

Every removal is verified with the edit distance to an earlier line.

Null and empty texts have no lines.  Rows that agree in id and text are one
document with one decision.  The report has one row per row of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcore.llm.common import bounded, join_counted, materialize, prepare
from weftcore.llm.textgrams import CHUNK, U64, _chunk_powers, _powers, mix64


def _row_key(doc_id: str, text: str) -> Column:
    ident = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("null"))  # a null id is not the id "null"
    return F.unhex(F.md5(F.concat_ws(":", ident, F.md5(F.coalesce(F.col(text), F.lit(""))))))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _row_key(doc_id, text).alias("row"))


def _lines(rows: DataFrame) -> DataFrame:
    out = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return out.withColumn("line_key", F.unhex(F.md5("line"))).withColumn("code", F.xxhash64("line"))


#: A group of at most this many lines is compared pair by pair; a larger one is cut into so many times more parts.
PAIRS, PARTS = 32, 8
#: Lines that a task remembers, so equal ones give their keys once.
SEEN = 1 << 20


def _whole_parts(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """(code, key): hashes of the parts, of edits + 1, that a line may share unchanged with one ``edits`` edits away."""
    m, seen = edits + 1, set()
    for batch in batches:
        # a line that this task met before has given its keys already
        code, first = np.unique(batch.column("code").to_numpy(), return_index=True)
        new = np.fromiter((c not in seen for c in code.tolist()), bool, len(code))
        code, first = code[new], first[new]
        if len(seen) > SEEN:
            seen.clear()
        seen.update(code.tolist())
        lines = batch.column("line").take(pa.array(first)).to_pylist()
        n = np.array(list(map(len, lines)), np.int64)
        start = np.cumsum(n) - n
        v = mix64(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1))
        up, down = _chunk_powers() if len(v) <= CHUNK else _powers(len(v) + 1)
        total = np.zeros(len(v) + 1, U64)
        np.cumsum(v * up[:len(v)], dtype=U64, out=total[1:])
        keys, codes = [], []
        for t in range(edits + 1):
            size = n + t
            for u in range(m):
                lo, hi = size * u // m, size * (u + 1) // m
                for j in range(max(0, t - (edits - u)), min(t, u) + 1):  # marks for no character before the part
                    fits = (lo >= j) & (size - hi >= t - j)
                    a, b = (start + lo - j)[fits], (start + hi - j)[fits]
                    keys.append(mix64((total[b] - total[a]) * down[a] ^ mix64((size[fits] * m + u).astype(U64))).view(np.int64))
                    codes.append(code[fits])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes)), pa.array(np.concatenate(keys))], names=["code", "key"])


@lru_cache(1 << 12)
def _choices(m: int, edits: int, within: tuple[int, ...] | None) -> list:
    """Ways to choose ``edits`` of m parts, ``within`` parts of the round before
    (none: of all), as arrays by the number t of marks that stand for no
    character: (t, parts, bounds and shifts of the pieces kept, bounds of the
    runs of chosen parts).  A choice of few runs is filled up with empty pieces."""
    parts = range(m) if within is None else [p * PARTS + k for p in within for k in range(PARTS)]
    held: dict[int, list] = {}
    for chosen in combinations(parts, edits):
        runs: list[list[int]] = []
        for p in chosen:
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        pad = edits - len(runs)
        lo, hi = [0, *[b for _, b in runs], *[m] * pad], [*[a for a, _ in runs], m, *[m] * pad]
        for none in product(*[range(b - a + 1) for a, b in runs]):
            shift = [0, *[sum(none[:k + 1]) for k in range(len(none))]]
            shift += [shift[-1]] * pad
            held.setdefault(shift[-1], []).append((chosen, lo, hi, shift, [k < len(runs) for k in range(edits)]))
    return [(t, *(np.array(x) for x in zip(*rows))) for t, rows in sorted(held.items())]


def _patterns(batches: Iterator[pa.RecordBatch], m: int, edits: int) -> Iterator[pa.RecordBatch]:
    """(key, code, parts, fine, r0, r1, ...): the chosen parts of a key, whether each is one
    character, and the hash of the line in each run of them (its code where a run is missing)."""
    for batch in batches:
        rows, held = [], 0
        given = batch.column("within").to_pylist() if "within" in batch.schema.names else [None] * batch.num_rows
        for line, code, within in zip(batch.column("line").to_pylist(), batch.column("code").to_pylist(), given):
            v = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64) + U64(1))
            n = len(v)
            up = (_chunk_powers() if n + edits <= CHUNK else _powers(n + edits + 1))[0]
            total = np.zeros(n + 1, U64)
            np.cumsum(v * up[:n], dtype=U64, out=total[1:])
            for parent in within or [None]:
                for t, chosen, lo, hi, shift, real in _choices(m, edits, None if parent is None else tuple(parent)):
                    bound = (n + t) * np.arange(m + 1) // m
                    a, b = bound[lo] - shift, bound[hi] - shift
                    ok = (a[:, 1:] >= b[:, :-1]).all(axis=1) & (a >= 0).all(axis=1) & (b <= n).all(axis=1)
                    if not ok.any():
                        continue
                    a, b, chosen = a[ok], b[ok], chosen[ok]
                    # the characters between the chosen parts, at their places in the pattern
                    text = ((total[b] - total[a]) * up[shift[ok]]).sum(axis=1, dtype=U64)
                    place = np.full(len(a), (n + t) * (1 << 24) + m, U64)
                    for k in range(edits):
                        place = mix64(place) + chosen[:, k].astype(U64)
                    inside = mix64((total[a[:, 1:]] - total[b[:, :-1]]) * up[shift[ok][:, :-1]] ^ mix64((a[:, 1:] - b[:, :-1]).astype(U64)))
                    inside = np.where(real[ok], inside.view(np.int64), code)
                    rows.append((mix64(text ^ mix64(place)).view(np.int64), np.full(len(a), code, np.int64), chosen.astype(np.int32), np.full(len(a), n + t <= m), inside))
                    held += len(a)
                if held > 1 << 16:
                    yield _pattern_batch(rows)
                    rows, held = [], 0
        if held:
            yield _pattern_batch(rows)


def _pattern_batch(rows: list) -> pa.RecordBatch:
    key, code, parts, fine, inside = (np.concatenate(x) for x in zip(*rows))
    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, parts.shape[1], dtype=np.int32)), pa.array(parts.ravel()))
    runs = [pa.array(np.ascontiguousarray(c)) for c in inside.T]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(code), listed, pa.array(fine), *runs], names=["key", "code", "parts", "fine", *[f"r{k}" for k in range(len(runs))]])


def _later(pairs: DataFrame, some: DataFrame, edits: int) -> DataFrame:
    """line_key of the later line of every pair (a, b) of codes that is within the bound."""
    side = lambda x: some.select(F.col("code").alias(x), F.struct("at", "line", "line_key").alias(f"_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    later = F.when(F.col("_a.at") < F.col("_b.at"), F.col("_b.line_key")).otherwise(F.col("_a.line_key"))
    return both.where(F.levenshtein("_a.line", "_b.line", edits).between(0, edits)).select(later.alias("line_key"))


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = 8, edits: int = 1) -> DataFrame:
    """(row, kept): the numbers of the lines that each document keeps, blank ones aside."""
    if edits < 1:
        raise ValueError(f"edits is at least 1, not {edits}")
    prepare(docs.sparkSession)
    lines = _lines(_rows(docs, doc_id, text))
    here = F.struct("doc_id", "row", "pos")
    first = materialize(lines.groupBy("line_key").agg(F.min(here).alias("at"), F.first("code").alias("code")), "lines")

    long = lines.where(F.length("line") >= shortest)
    keyed = materialize(long.select("line", "code").mapInArrow(partial(_whole_parts, edits=edits), "code long, key long"), "line-keys")
    shared = keyed.groupBy("key").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a < b").select("key")
    shared = materialize(shared, "parts")
    near = materialize(keyed.join(bounded(shared), "key", "left_semi").select("code").distinct(), "near")
    some = long.join(bounded(near), "code", "left_semi").groupBy("line_key").agg(F.first("line").alias("line"), F.first("code").alias("code"))
    some = materialize(some.join(first.select("line_key", "at"), "line_key"), "candidates")

    runs = [f"r{k}" for k in range(edits)]
    schema = ", ".join(["key long, code long, parts array<int>, fine boolean", *[f"{r} long" for r in runs]])
    gone, m, current = None, max(PARTS, 2 * (edits + 1)), some.select("line", "code")
    while True:
        slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = materialize(current.repartition(slots, "code").mapInArrow(partial(_patterns, m=m, edits=edits), schema), "patterns")
        # where all lines agree in a run, a choice with fewer runs has their pairs
        groups = keys.groupBy("key").agg(F.expr("min(code) < max(code)").alias("more"), *[F.expr(f"min({r}) < max({r})").alias(r) for r in runs])
        groups = materialize(groups.where(" AND ".join(["more", *runs])).select("key"), "groups")
        member = materialize(keys.join(bounded(groups), "key").select("key", "code", "parts", "fine").distinct(), "member")
        member = materialize(join_counted(member, member.groupBy("key").agg(F.count(F.lit(1)).alias("n")), ["key"], "n", member.count()), "member")
        few = member.where(F.col("n") <= PAIRS).groupBy("key").agg(F.sort_array(F.collect_set("code")).alias("c"))
        few = few.select(F.explode(F.transform("c", lambda x, i: F.struct(x.alias("a"), F.slice("c", i + 2, PAIRS).alias("bs")))).alias("p"))
        pairs = few.select("p.a", F.explode("p.bs").alias("b")).distinct()
        many = member.where(F.col("n") > PAIRS)
        least = many.where("fine").join(some.select("code", "at"), "code").groupBy("key").agg(F.min(F.struct("at", "code")).alias("e"))
        ends = many.where("fine").join(least, "key").select(F.col("e.code").alias("a"), F.col("code").alias("b")).where("a != b").distinct()
        found = materialize(_later(pairs.union(ends), some, edits).distinct(), "gone")
        gone = found if gone is None else gone.union(found)
        coarse = many.where("NOT fine").groupBy("code").agg(F.collect_set("parts").alias("within"))
        coarse = materialize(coarse, "coarse")
        if coarse.isEmpty():
            break
        current, m = some.select("line", "code").join(coarse, "code"), m * PARTS
    gone = materialize(gone.distinct(), "gone")
    kept = first.join(bounded(gone), "line_key", "left_anti").select("at.*")
    return kept.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Per row: doc_id, n_lines (blank ones aside), n_kept, kept (their numbers, from 0)."""
    rows = _rows(docs, doc_id, text)
    count = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    out = rows.select("doc_id", "row", count.alias("n_lines")).join(kept_lines(docs, doc_id, text, **more), "row", "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"), kept.alias("kept"))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t, kept in zip(batch.column("body").to_pylist(), batch.column("kept").to_pylist()):
            keep = set(kept or ())
            out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i in keep or not x.strip(" ")))
        yield batch.set_column(batch.schema.get_field_index("body"), "body", pa.array(out, pa.string()))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with texts of their kept (and blank) lines; same columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(_row_key(doc_id, text).alias("row"), F.col(text).alias("body"), row.alias("all")).join(kept_lines(docs, doc_id, text, **more), "row", "left")
    done = rows.mapInArrow(_clean, rows.schema)
    return done.select(*[(F.col("body") if c == text else F.col("all")[c]).alias(c) for c in docs.columns])
