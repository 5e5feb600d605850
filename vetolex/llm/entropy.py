"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Document rates ``r`` minimise the token-weighted relative entropy to rate 1 under the token
constraints ``sum(size * r) = target`` of every category of every constrained column.  The dual
is convex and its solution is an exponential tilt ``r = exp(sum of the categories' multipliers)``.
Newton steps solve it: within one column the Hessian is diagonal (a document has one category),
so each step updates all of a column's multipliers at once, columns in turn.  A step needs only
the tokens of each combination of categories, which one aggregation over the documents gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, stash

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)          # of the sources in code point order, repeating
SHARE = 1.5                  # of all words, over all sources
CEILING = 2                  # times its source's words that a target may reach
PHASE = 0.6180339887         # of the systematic rounding; irrational, so that no cut is a tie


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def capped_targets(sources: DataFrame, share: float = SHARE, ceiling: int = CEILING,
                   weights: tuple = WEIGHTS) -> DataFrame:
    """Add ``target`` to ``(key, tokens)`` rows: ``share`` of all tokens by weight, none above
    ``ceiling`` times its own, the excess shared again by weight until none is above.

    Sources are ranked by code point, null last.  Each pass fixes the sources at their ceiling
    and is one aggregation; the loop ends when a pass fixes no further source."""
    keyed = sources.withColumn("__null", F.col("key").isNull().cast("int"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    rows = stash(ranked(keyed, ["__null", "key"], "__pos").withColumn("weight", w).drop("__null", "__pos"), "weights")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    at_most = F.col("tokens") * ceiling
    level, fixed = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > at_most
        got = rows.agg(F.sum(F.when(capped, at_most).otherwise(0)).alias("taken"), F.count_if(capped).alias("n"),
                       F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("w")).first()
        if level is not None and (got["n"] == fixed or not got["w"]):
            break
        fixed = got["n"]
        level = (share * total - got["taken"]) / got["w"] if got["w"] else 0.0
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), at_most.cast("double")))


def balance(cells: DataFrame, families: dict[str, DataFrame], tol: float = 1e-12, max_steps: int = 200) -> DataFrame:
    """Add ``rate`` to ``cells``: rows (one column per family, ``tokens``), one per combination.

    ``families`` maps a column to its targets ``(key, target)``, one row per category, which may
    be many: they stay a table.  A damped Newton step on a category's multiplier is
    ``min((target - now) / now, 1)``.  Ends when no constraint is off by more than ``tol`` of its
    target; raises if the constraints contradict one another, so no unbalanced rate is returned.
    Categories without tokens or with target 0 get rate 0."""
    now = cells.select(*families, "tokens", F.lit(0.0).alias("lam"))
    for step in range(max_steps):
        worst = 0.0
        for column, targets in families.items():
            held = now.groupBy(column).agg(F.sum(F.col("tokens") * F.exp("lam")).alias("__held"))
            t = targets.select(F.col("key").alias("__key"), F.col("target").alias("__target"))
            off = (F.col("__target") - F.col("__held")) / F.col("__held")
            move = held.join(t, held[column].eqNullSafe(t["__key"])).select(
                F.col(column).alias("__k"), "__target", "__held",
                F.when(F.col("__target") <= 0, F.lit(-1e9)).when(F.col("__held") > 0, F.least(off, F.lit(1.0)))
                .otherwise(0.0).alias("__step"))
            move = stash(move, "move")
            gap = move.where("__target > 0 and __held > 0").agg(
                F.max(F.abs(F.col("__held") - F.col("__target")) / F.col("__target"))).first()[0] or 0.0
            worst = max(worst, gap)
            if gap > tol or step == 0:
                now = stash(now.join(move.select("__k", "__step"), now[column].eqNullSafe(F.col("__k")), "left")
                            .select(*families, "tokens", (F.col("lam") + F.coalesce("__step", F.lit(0.0))).alias("lam")), "dual")
        if worst <= tol:
            return now.withColumn("rate", F.exp("lam"))
    raise ValueError(f"entropy balancing: constraints still off by {worst:.3g} after {max_steps} Newton steps")


def round_copies(docs: DataFrame, group: str, rate: str, ties: list[str]) -> DataFrame:
    """Add ``copies``: each rate rounded down or up so that groups keep their tokens.

    Systematic rounding along the sizes: the documents of a group, ordered by size, are rounded
    up wherever the running sum of the fractions passes a whole number, so both the group's
    copies and its tokens stay within one document of the rates' sums."""
    docs = docs.withColumn("__null", F.col(group).isNull().cast("int"))
    rows = stash(ranked(docs, ["__null", group, "size", *ties], "__rank"), "ranks")
    first = rows.groupBy(group).agg(F.min("__rank").alias("__first")).withColumnRenamed(group, "__g")
    k = F.col("__rank") - F.col("__first")
    frac = F.col(rate) - F.floor(rate)
    up = F.floor((k + 1) * frac + PHASE) - F.floor(k * frac + PHASE)
    return (rows.join(first, rows[group].eqNullSafe(first["__g"]))
            .withColumn("copies", (F.floor(rate) + up).cast("long")).drop("__null", "__rank", "__first", "__g"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, key, size, source_size, target, rate, copies, taken)`` of every document.

    Size is the number of words (null text: 0; an empty document is never repeated for weight but
    keeps its rate).  A null source is a source of its own.  Repeated rows are rounded one by one.
    ``key`` is a hash of the text, which with doc_id names the row.  Only numbers are shuffled,
    never texts.  An empty table gives an empty result."""
    slim = stash(docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"),
                             word_count().alias("size")), "sizes")
    tokens = stash(slim.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("tokens")), "tokens")
    targets = stash(capped_targets(tokens), "targets")
    solved = balance(tokens.withColumnRenamed("key", "source"), {"source": targets.where("tokens > 0")})
    per_source = stash(targets.join(solved.select(F.col("source").alias("__s"), "rate"),
                                    targets["key"].eqNullSafe(F.col("__s")), "left")
                       .select(F.col("key").alias("__source"), F.col("tokens").alias("source_size"), "target",
                               F.least(F.coalesce("rate", F.lit(0.0)), F.lit(float(CEILING))).alias("rate")), "rates")
    rated = slim.join(per_source, slim["source"].eqNullSafe(per_source["__source"])).drop("__source")
    out = round_copies(rated, "source", "rate", ["doc_id", "key"])
    return out.withColumn("taken", F.col("copies") * F.col("size"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, sum(size) AS tokens, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
o AS (
  SELECT *, coalesce(sum(2 * tokens) OVER before, 0) AS full_before, sum(weight) OVER (ORDER BY tokens / weight, pos
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(tokens) OVER () AS total
  FROM w WINDOW before AS (ORDER BY tokens / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - full_before) / weight_left AS level FROM o),
lv AS (SELECT arg_min(level, (tokens / weight, pos)) FILTER (WHERE level * weight <= 2 * tokens) AS level FROM l),
t AS (SELECT source, tokens, least(weight * lv.level, 2.0::DOUBLE * tokens) AS target FROM w, lv),
r AS (
  SELECT doc_id, size, CAST(t.tokens AS BIGINT) AS source_size, t.target,
    CASE WHEN t.tokens > 0 THEN t.target / t.tokens ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CAST(floor(rate) + floor((k + 1) * (rate - floor(rate)) + 0.6180339887::DOUBLE)
    - floor(k * (rate - floor(rate)) + 0.6180339887::DOUBLE) AS BIGINT) AS copies FROM r)
SELECT doc_id, size, source_size, target, copies * size AS taken, rate, copies FROM c
"""
