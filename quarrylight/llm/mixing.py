"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Documents hang on a tree of domain, language and source. A token budget flows from the root down: at each node the children
share their parent's budget by weight, a child takes at most what its leaves can give (`max_epochs` passes over their tokens),
and what it cannot take goes to its siblings first. Since a child's capacity is the sum of its leaves', a shortage leaves a node
only when the whole node is short, so siblings are served before ancestors. Each leaf then takes whole passes over its documents
and, of one further pass, the longest prefix in seeded order whose tokens fit.

The prefix of a leaf is found in two steps: tokens are summed by hash bucket (the leading digits of the seeded order), the bucket
where the budget runs out is found on those sums, and only that bucket's documents are put in order. The number of digits grows
with the largest leaf, so a leaf that holds a third of all rows is never sorted in one task.

Defined results: a null text has no tokens; null lang or source is a leaf value of its own, written 'none'; documents without
tokens are in every pass; ties in seeded order are broken by doc_id and text; repeated rows count as often as they come; texts of
any length count whole; an empty table gives no rows; the caller's columns travel as one struct, so their names clash with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
#: Target weights; what is not named gets the last value.
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.3, "": 0.2}
LANG_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "": 0.05}
SOURCE_WEIGHTS: dict[str, float] = {"src0": 4.0, "": 1.0}
WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}
#: Least number of leading hex digits of the seeded order that name a bucket, and rows of a bucket that more digits aim at.
BUCKET_DIGITS, BUCKET_ROWS = 3, 4096
MAX_EPOCHS = 4
#: Leaves up to which the plan (a hundred bytes a leaf) is broadcast; tasks a leaf is spread over beyond that.
BROADCAST_LEAVES, SALTS = 50_000, 64
SEED = 7


def _weight(column: str, weights: dict[str, float]) -> Column:
    w = F.lit(weights[""])
    for k, v in weights.items():
        if k:
            w = F.when(F.col(column) == k, F.lit(v)).otherwise(w)
    return w


def domain() -> Column:
    """The domain of a source: by the number in its name (0 to 7 web, 8 to 13 reference, others books)."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    n = F.when(n != "", n.cast("int"))
    return F.when(n.isNull(), "other").when(n < 8, "web").when(n < 14, "reference").otherwise("books")


def shares(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Split each parent's budget among its rows by weight, at most `capacity` each; what is over goes to the siblings.
    Children that run out first (least capacity by weight) are settled first; the others share the rest by weight."""
    w = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[c for c in LEVELS if c in nodes.columns])
    before = F.coalesce(F.sum("capacity").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    n = nodes.withColumn("level", (F.col(budget) - before) / left)
    # once a child is not exhausted, no later one is: all of them share at the level of the first such child
    n = n.withColumn("open_level", F.when(F.col("level") * F.col("weight") < F.col("capacity"), F.col("level")))
    first = F.first("open_level", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return n.withColumn("at", first).withColumn(out, F.when(F.col("at").isNull(), F.col("capacity")).otherwise(F.col("at") * F.col("weight"))).drop("level", "open_level", "at", "capacity", "weight")


def allocate(leaves: DataFrame, budget: float | None = None, max_epochs: int = MAX_EPOCHS, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """leaves(domain, lang, source, supply) -> with take: tokens each leaf contributes. budget: all tokens of the corpus
    where none is given. weights: by level, those of its values ('' for the others)."""
    at = WEIGHTS | (weights or {})
    lv = leaves.withColumn("cap", F.col("supply") * float(max_epochs))
    root = lv.agg(F.sum("supply").alias("total"), F.sum("cap").alias("root_cap"))
    root = root.select(F.least(F.lit(float(budget)) if budget is not None else F.col("total").cast("double"), "root_cap").alias("b0"))
    domains = lv.groupBy("domain").agg(F.sum("cap").alias("capacity")).withColumn("weight", _weight("domain", at["domain"])).crossJoin(F.broadcast(root))  # root: one row
    domains = shares(domains.withColumn("root", F.lit(1)), ["root"], "b0", "b1").select("domain", "b1")
    langs = lv.groupBy("domain", "lang").agg(F.sum("cap").alias("capacity")).withColumn("weight", _weight("lang", at["lang"]))
    langs = shares(langs.join(domains, "domain"), ["domain"], "b1", "b2").select("domain", "lang", "b2")
    sources = lv.withColumn("capacity", F.col("cap")).withColumn("weight", _weight("source", at["source"]))
    return shares(sources.join(langs, ["domain", "lang"]), ["domain", "lang"], "b2", "b3").select("domain", "lang", "source", "supply", F.floor(F.col("b3") + 1e-6).cast("long").alias("take"))


def keyed(docs: DataFrame) -> DataFrame:
    """Rows of docs as a struct, beside their leaf, tokens and what orders them."""
    return docs.select(
        F.struct("*").alias("row"),
        domain().alias("domain"),
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(TOKEN)).cast("long").alias("tokens"),
        "doc_id",
    )


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))


def digits(rows: int) -> int:
    """Hex digits that name the buckets of a leaf of so many rows, so that a bucket stays small however large the leaf is."""
    n = BUCKET_DIGITS
    while rows > BUCKET_ROWS * 16**n:
        n += 1
    return n


def by_leaf(rows: DataFrame, plan: DataFrame, n_leaves: int) -> DataFrame:
    """Join rows with their leaf's line of the plan. A plan of few lines is broadcast after its size is known; a longer one is
    repeated SALTS times and joined on leaf and salt, so that a leaf with a third of all rows is spread over as many tasks."""
    if n_leaves <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(plan), [*LEVELS])
    salt = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(SALTS)).cast("int")
    salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(salted, [*LEVELS, "salt"]).drop("salt")


def mixed(docs: DataFrame, budget: float | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(row, domain, lang, source, tokens, epoch): every row of docs, as a struct, as often as its leaf takes it."""
    k = keyed(docs)
    supply = written(k.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"), F.count("*").alias("rows")), "supply")
    n_leaves, most = supply.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    n_digits = digits(most)
    lines = allocate(supply.drop("rows"), budget, max_epochs, weights).select(
        *LEVELS,
        F.when(F.col("supply") > 0, F.floor(F.col("take") / F.col("supply"))).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("supply") > 0, F.col("take") % F.col("supply")).otherwise(0).alias("rest"),
    )
    first = written(lines, "plan")
    discard(supply)
    # the epoch that is taken in part has its own order; tokens by bucket of that order
    part = by_leaf(k.select(*LEVELS, "doc_id", "tokens"), first, n_leaves).where("rest > 0")
    part = part.select(*LEVELS, "rest", "tokens", F.substring(order_key(seed, F.col("whole")), 1, n_digits).alias("bucket"))
    sums = part.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket"))
    cuts = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "bucket").alias("c"))
    plan = written(first.join(cuts.select(*LEVELS, "c.bucket", "c.room"), [*LEVELS], "left").select(*LEVELS, "whole", "rest", F.col("bucket").alias("cut"), "room"), "plan")
    discard(first)

    d = by_leaf(k, plan, n_leaves)
    key = order_key(seed, F.col("whole"))
    bucket = F.substring(key, 1, n_digits)
    last = F.when(F.col("rest") <= 0, F.lit("out")).when(F.col("cut").isNull() | (bucket < F.col("cut")), "in").when(bucket == F.col("cut"), "cut").otherwise("out")
    d = d.withColumn("last", last).withColumn("place", key)
    out = ["row", *LEVELS, "tokens"]
    whole = d.withColumn("n", F.col("whole") + F.when(F.col("last") == "in", 1).otherwise(0)).where("n > 0")
    whole = whole.select(*out, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch"))
    w = W.partitionBy(*LEVELS, "cut").orderBy("place", "doc_id", "row.text").rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = d.where("last = 'cut'").withColumn("upto", F.sum("tokens").over(w)).where("upto <= room").select(*out, F.col("whole").alias("epoch"))
    return whole.unionByName(edge)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as its leaf takes it; options are those of mixed()."""
    return mixed(docs, **options).select("row.*")


def oracle(docs: str = "documents", budget: str = "(SELECT CAST(sum(supply) AS DOUBLE) FROM leaves)", max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL of mix() over a table or CTE `docs`; ends in CTE mixed(doc columns, leaf columns, tokens, epoch)."""

    def case(column, weights):
        return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items() if k) + f" ELSE {weights['']} END"

    def level(name, rows, parent, order, cols, out):
        by = f"PARTITION BY {parent} ORDER BY capacity / weight, {order}"
        return f"""
{name}_l AS (SELECT *, (budget - coalesce(sum(capacity) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ({rows})),
{name}_o AS (SELECT *, CASE WHEN level * weight < capacity THEN level END AS open_level FROM {name}_l),
{name}_a AS (SELECT *, first_value(open_level IGNORE NULLS) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM {name}_o),
{name} AS (SELECT {cols}, CASE WHEN lv IS NULL THEN capacity ELSE lv * weight END AS {out} FROM {name}_a)"""

    return f"""
k AS (SELECT *, CASE WHEN num IS NULL THEN 'other' WHEN num < 8 THEN 'web' WHEN num < 14 THEN 'reference' ELSE 'books' END AS domain FROM (
  SELECT *, TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT) AS num, coalesce(lang, 'none') AS k_lang, coalesce(source, 'none') AS k_source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM {docs})),
leaves AS (SELECT domain, k_lang, k_source, CAST(sum(tokens) AS BIGINT) AS supply, sum(tokens) * CAST({max_epochs} AS DOUBLE) AS cap FROM k GROUP BY ALL),
root AS (SELECT least({budget}, sum(cap)) AS b0 FROM leaves),
{level("doms", f"SELECT domain, sum(cap) AS capacity, CAST({case('domain', DOMAIN_WEIGHTS)} AS DOUBLE) AS weight, b0 AS budget FROM leaves, root GROUP BY domain, b0", "1", "domain", "domain", "b1").strip()},
{level("lngs", f"SELECT l.domain, k_lang, sum(cap) AS capacity, CAST({case('k_lang', LANG_WEIGHTS)} AS DOUBLE) AS weight, b1 AS budget FROM leaves l JOIN doms USING (domain) GROUP BY l.domain, k_lang, b1", "domain", "k_lang", "domain, k_lang", "b2").strip()},
{level("srcs", f"SELECT l.domain, l.k_lang, k_source, supply, cap AS capacity, CAST({case('k_source', SOURCE_WEIGHTS)} AS DOUBLE) AS weight, b2 AS budget FROM leaves l JOIN lngs USING (domain, k_lang)", "domain, k_lang", "k_source", "domain, k_lang, k_source, supply", "b3").strip()},
plan AS (SELECT *, CAST(CASE WHEN supply > 0 THEN take // supply ELSE 1 END AS INT) AS whole, CASE WHEN supply > 0 THEN take % supply ELSE 0 END AS rest
  FROM (SELECT *, CAST(floor(b3 + 1e-6) AS BIGINT) AS take FROM srcs)),
seeded AS (SELECT k.*, whole, rest, md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'none')) AS ord FROM k JOIN plan USING (domain, k_lang, k_source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, k_lang, k_source ORDER BY ord, doc_id NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM seeded),
mixed AS (SELECT s.*, e.epoch FROM (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM summed) s, LATERAL (SELECT unnest(range(n)) AS epoch) e)"""


def query(docs: DataFrame) -> DataFrame:
    return mixed(docs).select("row.doc_id", *LEVELS, F.col("tokens").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"))


def query_oracle() -> str:
    return f"WITH {oracle().strip()} SELECT doc_id, domain, k_lang AS lang, k_source AS source, tokens AS n_tokens, CAST(epoch AS INT) AS epoch FROM mixed"
