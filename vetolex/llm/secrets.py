"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Patterns give candidate spans.  Each candidate's value is hashed and aggregated over the corpus
by distinct repositories and owners: a value that several owners share is a copied example, and so
is one in very many repositories; a value that one owner holds, in however few or more, looks live.  Values of the pattern kinds ``assign``, ``access`` and
``hex`` are always reported, with that verdict; looser ``opaque`` candidates (long tokens that mix
cases and digits) are reported only if their ownership says that they are specific to an owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, stash

#: kind -> (pattern of all leftmost matches, group whose length counts, least length)
KINDS = {
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    # with one class repeated to the end, the least length can stand in the pattern
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "opaque": (r"(?<![A-Za-z0-9_-])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: A text without this has no match of the kind; a cheap test that most texts fail.
NEEDS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{32}",
         "opaque": r"[A-Za-z0-9_-]{20}"}
#: A value that more owners hold is a copied example; so is one that its owner has spread over more repositories than this.
MAX_REPOS, MAX_OWNERS = 100, 1
SALTS = 16


def _spans(text: F.Column, kind: str) -> F.Column:
    """Array of (kind, start, end, value) in code points; leftmost, non-overlapping.

    The pieces between matches and the matches themselves alternate, so lengths give positions."""
    pattern, group, least = KINDS[kind]
    has = text.rlike(NEEDS[kind])
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    code = list(KINDS).index(kind)
    rows = F.arrays_zip(pieces.alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    walked = F.aggregate(
        rows, F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("at"),
            F.when(x["whole"].isNull() | (F.length(x["value"]) < least), s["found"]).otherwise(
                F.concat(s["found"], F.array(F.struct(
                    (s["at"] + x["gap"]).alias("start"), F.lit(code).alias("kind"),
                    (s["at"] + x["gap"] + F.length(x["whole"])).alias("end"), x["value"].alias("value"))))).alias("found")))
    return F.when(has, walked["found"]).otherwise(empty)


def find_secrets(docs: DataFrame, repo: str = "source", owner: str | None = None, max_repos: int = MAX_REPOS,
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """``(doc_id, spans)`` per document: spans are structs (start, kind, end, repos, owners, live).

    ``repo`` names the repository column; the owner is the part of it before the first slash
    unless a column is given.  Null texts are empty; a null repository counts as one repository of
    its own.  Repeated rows give equal rows, an empty table an empty result.  Texts are read once
    and never shuffled; what moves is one row per candidate.  A value that a third of the
    documents hold is reduced to its distinct repositories before the count, and its verdict goes
    back to the documents in ``SALTS`` parts, so no task gets all of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    before = F.regexp_extract(F.col(repo), r"^[^/]*", 0)
    owned = F.col(owner) if owner else F.when(before == "", F.col(repo)).otherwise(before)  # null: one owner, as one repository
    slim = docs.select("doc_id", row_key().alias("__row"), F.col(repo).alias("__repo"),
                       owned.alias("__owner"), F.concat(*[_spans(text, k) for k in KINDS]).alias("__found"))
    hashed = F.transform("__found", lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("value")))
    slim = stash(slim.withColumn("__found", hashed), "candidates")
    cand = (slim.where(F.size("__found") > 0).select("__row", "__repo", "__owner", F.explode("__found").alias("x"))
            .select("__row", "__repo", "__owner", "x.*"))
    held = cand.groupBy("value", "__repo", "__owner").agg(F.lit(1).alias("one"))
    owners = held.groupBy("value", "__owner").agg(F.count(F.lit(1)).alias("n"))
    freq = owners.groupBy("value").agg(F.sum("n").alias("repos"), F.count(F.lit(1)).alias("owners"))
    salted = freq.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = (cand.select("__row", "start", "kind", "end", "value").distinct()
             .withColumn("__salt", F.pmod(F.hash("__row"), F.lit(SALTS)).cast("int")).join(salted, ["value", "__salt"])
             .withColumn("live", (F.col("repos") <= max_repos) & (F.col("owners") <= max_owners)))
    base = [list(KINDS).index(k) for k in BASE]
    kept = spans.where(F.col("kind").isin(base) | F.col("live"))
    per_row = kept.groupBy("__row").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "repos", "owners", "live"))).alias("spans"))
    none = F.array().cast(per_row.schema["spans"].dataType)
    return (slim.select("doc_id", "__row").join(per_row, "__row", "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
                        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))
