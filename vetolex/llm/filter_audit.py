"""Filter interaction audit: what each filter removes in every order of applying them.

A filter set removes the documents that fail any of its filters: a game over the 32 coalitions of
five filters.  Its Hart-Mas-Colell potential is computed recursively,
``P(S) = (v(S) + sum of P(S without i)) / |S|``; the Shapley value of a filter is the potential of
all filters minus the potential without that filter.  What a step of an order removes is the value
of the coalition after it minus the value before.  Documents are reduced to one row per part and
set of failed filters, so orders are never replayed over documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_bytes

FILTERS = "ABCDE"
MIN_WORDS = 200            # A
DISTINCT_PERCENT = 50      # B: least share of distinct words
UPPER_PERCENT = 3          # C: most share of capitals
SYMBOLS = b"#$%&*|"        # D
DUPLICATE = 1 << FILTERS.index("E")
LONG = 4 << 20             # bytes of a text whose words are not listed all at once

_UPPER, _CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def failed(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    if len(raw) < LONG:
        words = raw.split()
        n, distinct = len(words), len(set(words))
    else:
        seen, n = set(), 0
        for m in _WORD.finditer(raw):
            seen.add(m.group())
            n += 1
        distinct = len(seen)
    upper, points = len(raw) - len(raw.translate(None, _UPPER)), len(raw.translate(None, _CONTINUATION))
    return ((n < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * points) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def judged(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``(doc_id, part, text_key, mask)`` of every row; the key is a 128-bit hash of the text."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                 pa.array([failed(t) for t in texts], pa.int32())], ["doc_id", "part", "text_key", "mask"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       text_bytes().alias("text")).mapInArrow(judge, "doc_id long, part string, text_key binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents by the filters that they fail and their labels.

    E is failed by rows whose text a row of smaller doc_id has.  Rows are counted per text, part and
    label first, so a text in very many documents is a few rows when its least doc_id is looked up."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    keys = ["text_key", "part", "mask", "good", "toxic"]
    rows = judged(docs, part)
    # without doc_id there is no label and no smaller doc_id
    anonymous = rows.where("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    named = (rows.where("doc_id is not null").join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
             .groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("c")))
    texts = named.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("doc_id").alias("low"), F.min_by("c", "doc_id").alias("first"))
    least = F.min("low").over(Window.partitionBy("text_key"))  # a text's rows: at most one per part and label
    first = F.when(F.col("low") == F.col("least"), F.col("first")).otherwise(F.lit(0))
    split = texts.withColumn("least", least).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), first.cast("long").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(DUPLICATE)).alias("mask"), (F.col("n") - first).cast("long").alias("n")))).alias("x"))
    found = split.select("part", "x.mask", "good", "toxic", "x.n").where("n > 0").unionByName(anonymous)
    return found.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def potentials(v: list[int], players: int) -> list[int]:
    """The potential of every coalition (a bit set), times ``players`` factorial, which makes each a whole number."""
    scale, out = factorial(players), [0] * (1 << players)
    for s in range(1, 1 << players):
        below = [out[s ^ (1 << i)] for i in range(players) if s >> i & 1]
        out[s] = (scale * v[s] + sum(below)) // len(below)
    return out


def orders(all_: int, v: list[int], good: list[int], toxic: list[int], filters: str = FILTERS) -> Iterator[tuple]:
    """Every step of every order: (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    ``v``, ``good`` and ``toxic`` are what each coalition removes, of all, of good and of toxic documents."""
    whole = len(v) - 1
    potential = potentials(v, len(filters))
    shapley = [potential[whole] - potential[whole ^ (1 << i)] for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            yield ("".join(filters[j] for j in order), step, all_ - v[after], removed, v[1 << i] - removed, v[whole] - v[whole ^ (1 << i)],
                   good[after] - good[before], toxic[after] - toxic[before], shapley[i])
            before = after


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step.

    Null texts are empty, a null part is the empty string; equal texts count as duplicates of the
    least doc_id, equal rows of the least doc_id pass together; rows without doc_id have no labels
    and are no duplicates.  A doc_id labelled more than once is good (toxic) if any label says so.
    Long texts are read whole.  Empty tables give no rows; other columns are not read."""
    size = 1 << len(FILTERS)

    def game(wanted: F.Column) -> F.Column:
        return F.array(*[F.sum(F.when(wanted & (F.col("mask").bitwiseAND(F.lit(s)) != 0), F.col("n")).otherwise(F.lit(0))) for s in range(size)])

    games = cells(docs, labels, part).groupBy("part").agg(
        F.sum("n").alias("total"), game(F.lit(True)).alias("v"), game(F.col("good") == 1).alias("good"), game(F.col("toxic") == 1).alias("toxic"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(orders(r["total"], r["v"], r["good"], r["toxic"]))
                order, step, *counts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(rows)), pa.array(order), pa.array(step, pa.int32()), *[pa.array(c, pa.int64()) for c in counts]],
                    ["part", "filter_order", "step", *_COUNTS])

    return games.mapInArrow(steps, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


#: The same by replaying every order over the counted documents.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false) AS INT) AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (
  SELECT o, s, 1 << (ascii(o[s]) - 65) AS bit,
         coalesce(list_sum([1 << (ascii(o[i]) - 65) FOR i IN range(1, s)]), 0) AS before
  FROM o, range(1, 6) r(s)),
g AS (
  SELECT part, o, s, bit, sum(n) FILTER (mask & (before + bit) = 0) AS kept,
         sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS removed,
         sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS redundant,
         sum(n) FILTER (mask = bit) AS unique_fails,
         sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND good = 1) AS good_lost,
         sum(n) FILTER (mask & before = 0 AND mask & bit <> 0 AND toxic = 1) AS toxic_lost
  FROM c, (SELECT o, s, bit, CAST(before AS INT) AS before FROM s) GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM g
"""
