"""Source divergence audit by count-level bitmaps.

Per language the terms of enough documents are kept and numbered.  For every group (language and
source) and every count, a bitmap holds the terms that occur so often there.  The terms on which
two groups have the counts a and b are the bits common to the two bitmaps, so AND and popcount give
each pair's joint cells; a cell is multiplied by its divergence, and the cells in which a group has
no occurrence follow by complement.  Bitmaps are compared in blocks of term numbers, most frequent
terms first: there the counts differ, and in the long tail a block has only a few levels.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.topk import top_k_per_group
from .common import ranked, stash, text_bytes

MIN_DOCUMENTS = 3
UNIT = 1_000_000_000       # of a probability
TOP_TERMS = 200            # of a group in the report
BLOCK = 512                # term numbers in a block of bitmaps
TILE = 64                  # sources that one task compares with as many others
HELD = 200_000             # distinct terms that a task counts before it hands them on
CELLS = 1 << 20            # joint cells computed at a time

_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, df, n)``: documents and occurrences, added up over tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = defaultdict(Counter), defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(*g, t, df[g][t], c) for g, terms in n.items() for t, c in terms.items()]
            lang, source, term, d, c = zip(*rows) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()),
                                               pa.array(d, pa.int64()), pa.array(c, pa.int64())], ["lang", "source", "term", "df", "n"])

        held = 0
        for batch in batches:
            for lang, source, raw in zip(*(batch.column(i) for i in range(3))):
                g = lang.as_py(), source.as_py()
                terms = raw.as_py().translate(_TERMS).split()
                held -= len(df[g])
                n[g].update(terms)
                df[g].update(set(terms))
                held += len(df[g])
                if held > HELD:
                    yield out()
                    df.clear()
                    n.clear()
                    held = 0
        yield out()

    return _named(docs).select("lang", "source", text_bytes().alias("text")).mapInArrow(
        count, "lang string, source string, term string, df long, n long").groupBy("lang", "source", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("n"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], "text")


def share(count: str, total: str, kept: str) -> F.Column:
    """The smoothed share of a count in whole units; decimal, since a count times the unit may pass 64 bits."""
    return F.expr(f"CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0)) div CAST({total} + {kept} AS DECIMAL(20,0)) + 1")


def term_numbers(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, total, number)`` of each language's kept terms, the frequent ones first."""
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total")).where(F.col("df") >= min_documents).withColumn(
        "less", -F.col("total"))
    return stash(ranked(kept.select("lang", "less", "term", "total"), ["lang", "less", "term"], "number").drop("less"), "terms")


def margins(docs: DataFrame, kept: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, total, kept, lang_total, sources)`` of every group that occurs, without terms too."""
    groups = _named(docs).select("lang", "source").distinct()
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total")), "lang", "left")
    return stash(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
                 .na.fill(0, ["total", "kept", "lang_total"]), "margins")


def bitmaps(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(lang, source, block, n, word, bits)``: the bitmap of a group's terms of count n, as its 64-bit words that are not zero."""
    at = F.pmod("number", F.lit(block))
    bit = F.expr(f"shiftleft(1L, CAST(number % {block} % 64 AS INT))")
    return kept.groupBy("lang", "source", F.expr(f"number div {block}").alias("block"), "n", F.floor(at / 64).cast("int").alias("word")).agg(
        F.bit_or(bit).alias("bits"))


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compared(table: pa.Table) -> pa.Table:
    """``(lang, source, item, value)`` of the ordered pairs of groups, over one block of terms.

    Rows without ``n`` name the groups with their share at count 0; the others are bitmap words."""
    named = table.column("n").is_valid()
    head, body = table.filter(pc.invert(named)).sort_by("source").combine_chunks(), table.filter(named).combine_chunks()
    names = np.array(head.column("source").to_pylist(), object)
    zero, tile = (head.column(c).to_numpy() for c in ("p", "tile"))
    all_ = int(head.column("terms")[0].as_py())
    n, word, bits, share_ = (body.column(c).to_numpy() for c in ("n", "word", "bits", "p"))
    place = {s: i for i, s in enumerate(names.tolist())}
    who = np.array([place[s] for s in body.column("source").to_pylist()], np.int64)
    # levels: one bitmap per group and count; a group's levels are neighbours
    level_key, level = np.unique(np.stack([who, n]), axis=1, return_inverse=True)
    level = level.ravel()
    maps = np.zeros((level_key.shape[1], BLOCK // 64), np.uint64)
    maps[level, word] = bits.view(np.uint64)
    p = np.zeros(len(maps), np.int64)
    p[level] = share_
    size = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
    owner = level_key[0]
    a, b = int(table.column("a")[0].as_py()), int(table.column("b")[0].as_py())
    rows = []
    for g in range(len(names)):
        partners = np.flatnonzero(tile == (b if tile[g] == a else a))
        partners = partners[partners != g]
        if not len(partners):
            continue
        mine, other = np.flatnonzero(owner == g), np.flatnonzero(np.isin(owner, partners))
        held = np.bincount(owner, size, len(names)).astype(np.int64)
        value, joint = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        met = np.zeros(len(other), np.int64)          # of each level of the others, terms that g has too
        if len(other):
            there, starts = np.unique(owner[other], return_index=True)
            step = max(1, CELLS // len(other))
            for i in range(0, len(mine), step):
                at = mine[i:i + step]
                cells = np.zeros((len(at), len(other)), np.int64)
                for w in range(maps.shape[1]):
                    cells += np.bitwise_count(maps[at, w][:, None] & maps[other, w][None, :])
                value[there] += np.add.reduceat(cells * _divergence(p[at][:, None], p[other][None, :]), starts, axis=1).sum(axis=0)
                both = np.add.reduceat(cells, starts, axis=1)
                met += cells.sum(axis=0)
                joint[there] += both.sum(axis=0)
                # terms of g that the other group has not
                value[there] += ((size[at][:, None] - both) * _divergence(p[at][:, None], zero[there][None, :])).sum(axis=0)
            # terms of the other group that g has not
            value[there] += np.add.reduceat((size[other] - met) * _divergence(zero[g], p[other]), starts)
        empty = partners[held[partners] == 0]
        if len(mine) and len(empty):
            value[empty] += (size[mine][:, None] * _divergence(p[mine][:, None], zero[empty][None, :])).sum(axis=0)
        value[partners] += (all_ - held[g] - held[partners] + joint[partners]) * _divergence(zero[g], zero[partners])
        rows += [(names[g], names[h], int(value[h])) for h in partners.tolist()]
    lang = table.column("lang")[0].as_py()
    s, item, v = zip(*rows) if rows else ((), (), ())
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "source": pa.array(s, pa.string()), "item": pa.array(item, pa.string()),
                     "value": pa.array(v, pa.int64())})


def pair_values(kept: DataFrame, terms: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of groups of a language.

    A task gets one block of terms and two tiles of at most about TILE sources, whatever the number of sources."""
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    tiled = groups.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    levels = bitmaps(kept).join(tiled.drop("sources", "lang_total").withColumnRenamed("kept", "vocabulary"), ["lang", "source"]).select(
        "lang", "block", "source", "tile", "tiles", F.lit(None).cast("long").alias("terms"), "n", share("n", "total", "vocabulary").alias("p"), "word", "bits")
    sizes = terms.groupBy("lang", F.expr(f"number div {BLOCK}").alias("block")).agg(F.count(F.lit(1)).alias("terms"))
    heads = sizes.join(tiled, "lang").select(
        "lang", "block", "source", "tile", "tiles", "terms", F.lit(None).cast("long").alias("n"), share("0", "total", "kept").alias("p"),
        F.lit(None).cast("int").alias("word"), F.lit(None).cast("long").alias("bits"))
    with_ = levels.unionByName(heads).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = with_.select("lang", "block", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"),
                         "source", "tile", "terms", "n", "p", "word", "bits")
    found = dealt.groupBy("lang", "block", "a", "b").applyInArrow(compared, "lang string, source string, item string, value long")
    found = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    return found.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("long").alias("value")))


def term_values(kept: DataFrame, terms: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms that a group uses more than its language, by their divergence."""
    met = kept.join(groups.withColumnRenamed("total", "group_total").withColumnRenamed("kept", "vocabulary"), ["lang", "source"])
    rows = met.select("lang", "source", F.col("term").alias("item"), share("n", "group_total", "vocabulary").alias("p"),
                      share("total", "lang_total", "vocabulary").alias("q")).where("p > q")
    rows = rows.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return top_k_per_group(rows, ["lang", "source"], [F.col("value").desc(), F.col("item")], top, "item")


def audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` compares each group with every other source of
    its language, part ``term`` with its language.

    Null text, lang and source are read as ''.  Repeated rows are documents of their own; empty texts
    make a group without terms, whose counts are all 0; a language without kept terms has pairs of
    value 0 and no terms.  Long texts are read whole.  Ties go by the item's bytes.  An empty table
    gives no rows; other columns are not read.  Values are exact while they fit 64 bits, which holds
    for less than 500 million kept terms a language."""
    counts = stash(term_counts(docs), "counts")
    terms = term_numbers(counts)
    kept = stash(counts.drop("df").join(terms, ["lang", "term"]), "kept")
    groups = margins(docs, kept, terms)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_values(kept, terms, groups).withColumn("rank", F.row_number().over(order))
    return (pairs.withColumn("part", F.lit("pair")).unionByName(term_values(kept, terms, groups, top).withColumn("part", F.lit("term")))
            .select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
m AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, v.v,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // CAST(n + v AS HUGEINT) AS p FROM m),
lt AS (SELECT lang, term, sum(c) AS c, any_value(v) AS v FROM m GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // CAST(sum(c) OVER (PARTITION BY lang) + v AS HUGEINT) AS q FROM lt),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tops AS (SELECT p.lang, source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
         FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
