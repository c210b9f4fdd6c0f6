"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token weights are raked:
scaled to the target share of each source, then of each language, then of each topic, over
and over, so that all three marginals are met while the corpus's own associations stay.
A cell's keep probability is its weight over its tokens, times one factor. Without a budget
that is the greatest factor at which no cell exceeds 1, so no more tokens go than the targets
need; with one it makes the expected tokens kept the budget's share, and cells that would
exceed 1 are kept whole and the factor grows for the rest. A document stays if a number in [0, 1) from md5 of seed and id is below
its cell's probability.

Targets are shares proportional to tokens to a power (0.5 for sources, 0.7 for languages, 1
for topics, which keeps the corpus's shares of topics while sources and languages move), or given shares; a value that is not among given shares has the target 0. Only the
table of cells is shuffled; documents meet it in a broadcast join while it has at most
MAX_CELLS rows, and in a shuffled join beyond that. Sums over the cells of a value are windows while cells are so few, and partial
aggregates joined back beyond that, so values may be as many as web hosts, and one may have most cells.

Nulls in source, language or text: a cell value of '', and no tokens. Cells without tokens are
kept whole. Very long texts count whole. Ties don't matter: cells of one ratio have one probability. A null id counts as ''; rows of one id are kept or dropped together. An empty
table gives no rows. Results are one struct column, in place of an input column of that name;
input columns have stand-in names inside, so they can't clash.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlog.workspace import materialize

from .tables import table

logger = logging.getLogger("strandlog")
ROUNDS = 12
ROUNDS_A_TABLE = 4
#: The share of tokens that op7's query keeps, as its SQL states.
BUDGET = 0.5
POWERS = {"source": 0.5, "lang": 0.7, "topic": 1.0}
MAX_CELLS = 20_000
#: Greatest difference of a marginal from its target at which raking ends, and blocks of the cells' order.
TOLERANCE, BLOCKS = 1e-13, 64
SEED = "mix-1"

#: Topics by what a text holds; the first that matches.
TOPICS = (
    ("legal", r"(?i)licensed under|all rights reserved|released under the|copyright"),
    ("credentials", r"(?i)password|secret|token ?[=:]|AKIA"),
    ("contact", r"@"),
    ("listing", r"\|.*\|.*\|"),
)


def topic_of(text: Column) -> Column:
    out = F
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("general")


def tokens_of(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _with_sums(cells: DataFrame, name: str, *sums: Column) -> DataFrame:
    """cells with sums over the cells of a marginal's value: partial aggregates joined back, as one value may have most cells."""
    own = cells.groupBy(name).agg(*sums).withColumnRenamed(name, "_value")
    return cells.join(own, cells[name] == own["_value"]).drop("_value")


def _off(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> float:
    """The greatest difference of a marginal's share from its target."""
    far = [cells.groupBy(n).agg(F.abs(F.sum("weight") - F.max(f"_t_{n}")).alias("_off")).select("_off") for n in targets]
    return reduce(DataFrame.union, far).agg(F.max("_off")).first()[0] or 0.0


def _with_totals(cells: DataFrame, *sums: Column) -> DataFrame:
    """cells with sums over all of them: one row, broadcast."""
    return cells.join(F.broadcast(cells.agg(*sums)))


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (one column for each marginal, and tokens) with weight: shares that meet the targets in the last round's order.

    Ends before `rounds` when no marginal is further from its target than tolerance. Targets that can't all be met (a value
    without tokens has a share) leave a difference, which is logged.
    """
    out = _with_totals(cells, F.sum("tokens").alias("_total"))
    out = out.withColumn("weight", F.col("tokens") / F.when(F.col("_total") > 0, F.col("_total"))).drop("_total")
    for name, target in targets.items():
        if isinstance(target, Mapping):
            shares = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, float(v))])
            out = out.withColumn(f"_t_{name}", F.coalesce(F.try_element_at(shares, F.col(name)), F.lit(0.0)))
        else:
            sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("_own")).filter("_own > 0").withColumn("_power", F.pow("_own", F.lit(float(target))))
            sums = _with_totals(sums, F.sum("_power").alias("_powers")).select(F.col(name).alias("_value"), (F.col("_power") / F.col("_powers")).alias(f"_t_{name}"))
            out = out.join(sums, out[name] == sums["_value"], "left").drop("_value").withColumn(f"_t_{name}", F.coalesce(f"_t_{name}", F.lit(0.0)))
    out = materialize(out, "cells")
    off, many = 0.0, out.count() > MAX_CELLS
    for i in range(rounds):
        for name in targets:
            if many:
                out = _with_sums(out, name, F.sum("weight").alias("_have"))
            else:
                out = out.withColumn("_have", F.sum("weight").over(W.partitionBy(name)))
            out = out.withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * F.col(f"_t_{name}") / F.col("_have")).otherwise(0.0)).drop("_have")
            if many:
                out = materialize(out, "cells")
        if i % ROUNDS_A_TABLE == ROUNDS_A_TABLE - 1 or i == rounds - 1:
            out = out if many else materialize(out, "cells")
            off = _off(out, targets)
            if off <= tolerance:
                break
    if off > 1e-3:
        logger.info("after %d rounds a marginal is %.2g from its target", rounds, off)
    return out.drop(*[f"_t_{name}" for name in targets])


def _ordered_sums(cells: DataFrame, names: list[str]) -> DataFrame:
    """cells with _before, tokens of the cells of higher ratio, and _after, weights of this cell and those of lower ratio.

    Sums run within blocks of the order, and over one row a block.
    """
    bounds = cells.agg(F.percentile_approx("_ratio", [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS)).first()[0] or []
    above = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b >= F.col("_ratio"))) if bounds else F.lit(0)
    rows = cells.withColumn("_block", F.when(F.col("_ratio").isNull(), BLOCKS).otherwise(above))
    order, blocks = W.partitionBy("_block").orderBy(F.col("_ratio").desc(), *names), W.orderBy("_block")
    sums = rows.groupBy("_block").agg(F.sum("tokens").alias("_t"), F.sum("weight").alias("_w"))
    sums = sums.select(
        F.col("_block").alias("_b"), F.coalesce(F.sum("_t").over(blocks.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_t"),
        F.coalesce(F.sum("_w").over(blocks.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0)).alias("_w"),
    )
    rows = rows.join(F.broadcast(sums), F.col("_block") == F.col("_b"))  # BLOCKS + 1 rows
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_t")
    after = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)) + F.col("_w")
    return rows.withColumns({"_before": before, "_after": after}).drop("_block", "_b", "_t", "_w")


def calibrated(cells: DataFrame, budget: float | None = None) -> DataFrame:
    """cells with p: keep probabilities in proportion to weight over tokens whose expected tokens are the budget's share, or as many as can be."""
    names = [c for c in cells.columns if c not in ("tokens", "weight")]
    out = cells.withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))
    if budget is None:
        out = _with_totals(out, F.max("_ratio").alias("_most"))
        p = F.when(F.col("_ratio").isNull(), 1.0).otherwise(F.coalesce(F.col("_ratio") / F.when(F.col("_most") > 0, F.col("_most")), F.lit(0.0)))
        return out.select(*names, "tokens", "weight", p.alias("p"))
    out = _with_totals(_ordered_sums(out, names), (F.sum("tokens") * budget).alias("_need"))
    full = (F.col("_ratio") > 0) & ((F.col("_need") - F.col("_before")) * F.col("_ratio") >= F.col("_after"))
    out = materialize(out.withColumn("_full", F.coalesce(full, F.lit(False))), "cells")
    out = _with_totals(out, F.sum(F.when(F.col("_full"), F.col("tokens"))).alias("_taken"), F.sum(F.when(~F.col("_full"), F.col("weight"))).alias("_rest"))
    factor = (F.col("_need") - F.coalesce("_taken", F.lit(0))) / F.when(F.col("_rest") > 0, F.col("_rest"))
    p = F.when(F.col("_ratio").isNull() | F.col("_full"), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(factor * F.col("_ratio"), F.lit(0.0)))))
    return out.select(*names, "tokens", "weight", p.alias("p"))


def draw(id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the seed and the id decide."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic: Column | None = None,
    targets: Mapping[str, Mapping[str, float] | float] = POWERS, budget: float | None = None, out: str = "mix", without_text: bool = False,
) -> DataFrame:
    """docs with a struct column out: source, lang, topic, n_tokens, weight and p of the cell, kept.

    without_text: the text isn't among the result's columns; then texts are read once, and what is known of them is written.
    """
    docs = docs.drop(out)
    body = F.coalesce(docs[text], F.lit(""))
    named = {"source": F.coalesce(docs[source].cast("string"), F.lit("")), "lang": F.coalesce(docs[lang].cast("string"), F.lit("")), "topic": F.coalesce(topic, F.lit("")) if topic is not None else topic_of(body)}
    columns = [c for c in docs.columns if not (without_text and c == text)]
    own = [docs[c].alias(f"_in{i}") for i, c in enumerate(columns)]
    rows = docs.select(*own, *[c.alias(n) for n, c in named.items()], tokens_of(body).alias("n_tokens"), draw(docs[id]).alias("_u"))
    if without_text:
        rows = materialize(rows, "counted")
    cells = rows.groupBy(*named).agg(F.sum("n_tokens").alias("tokens"))
    cells = materialize(calibrated(raked(materialize(cells, "cells"), targets), budget), "mix").withColumnsRenamed({n: f"_{n}" for n in (*named, "tokens", "weight", "p")})
    if cells.count() <= MAX_CELLS:
        cells = F.broadcast(cells)
    rows = rows.join(cells, [rows[n] == cells[f"_{n}"] for n in named])
    found = F.struct(*named, "n_tokens", F.col("_weight").alias("weight"), F.col("_p").alias("p"), (F.col("_u") < F.col("_p")).alias("kept"))
    return rows.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)], found.alias(out))


def sample(docs: DataFrame, out: str = "_mix", **given) -> DataFrame:
    """The rows of docs that stay, unchanged."""
    return mix(docs, out=out, **given).filter(F.col(out)["kept"]).drop(out)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), budget=BUDGET, without_text=True)
    m = F.col("mix")
    return mixed.select("doc_id", *[m[c].alias(c) for c in ("source", "lang", "topic", "n_tokens")], F.round(m["p"], 9).alias("p"), m["kept"].alias("kept"))


def _sql() -> str:
    steps = []
    last = "t"
    for i in range(ROUNDS):
        for name in POWERS:
            step = f"r{i}_{name}"
            have = f"sum(weight) OVER (PARTITION BY {name})"
            steps.append(f"{step} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {have} > 0 THEN weight * t_{name} / {have} ELSE 0 END AS weight) FROM {last})")
            last = step
    topics = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in TOPICS)
    powers = ", ".join(f"CASE WHEN sum(tokens) OVER (PARTITION BY {n}) > 0 THEN pow(sum(tokens) OVER (PARTITION BY {n}), {p}) / count(*) OVER (PARTITION BY {n}) ELSE 0 END AS p_{n}" for n, p in POWERS.items())
    shares = ", ".join(f"p_{n} * count(*) OVER (PARTITION BY {n}) / sum(p_{n}) OVER () AS t_{n}" for n in POWERS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topics} ELSE 'general' END AS topic,
  len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens
  FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)),
c AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
q AS (SELECT *, tokens::DOUBLE / sum(tokens) OVER () AS weight, {powers} FROM c),
t AS MATERIALIZED (SELECT source, lang, topic, tokens, weight, {shares} FROM q),
{", ".join(steps)},
o AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens END AS ratio FROM {last}),
f AS (SELECT *, sum(tokens) OVER () * {BUDGET} AS need,
  coalesce(sum(tokens) OVER (ORDER BY ratio DESC NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY ratio DESC NULLS LAST, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM o),
g AS (SELECT *, ratio > 0 AND (need - before) * ratio >= after AS whole FROM f),
h AS (SELECT source, lang, topic, CASE WHEN ratio IS NULL OR whole THEN 1.0 ELSE least(1.0, greatest(0.0,
  coalesce((need - coalesce(sum(tokens) FILTER (whole) OVER (), 0)) / nullif(sum(weight) FILTER (NOT whole) OVER (), 0) * ratio, 0.0))) END::DOUBLE AS p FROM g)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS p,
  ('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / pow(2, 52) < p AS kept
FROM d JOIN h USING (source, lang, topic)
"""


OP7_SQL = _sql()
