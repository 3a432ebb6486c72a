"""Operator 8: mixing to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents are summed into cells (source, language, topic; tokens). Raking scales one margin after another to its targets, in a small
table of cells that is written after each sweep. A cell's weight is the
product of its three factors; weights divided by the largest are the probabilities with which documents are sampled, so
expected tokens follow the targets and nothing has to be repeated. The draw is a hash of seed and doc_id: the same on every run.

The join with the cells' weights has no hint: Spark broadcasts them where they are small, else it shuffles and splits hot values.

Defined results: a null source, language or topic counts as the value ``''``; null text has no tokens, and it or a text
without keyword topic ``none``; a value without a target keeps factor 1, as does a margin value without tokens; repeated ids are drawn alike; no rows give no rows;
columns of the documents stay, whatever their names,
but for one with the new column's name in any case, which that replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, columns, stored, table

MARGINS = ("source", "lang", "topic")
SWEEPS = 8
#: Default targets are a margin's own token shares to this power: sources and languages are evened out, topics kept.
TEMPERATURE = {"source": 0.8, "lang": 0.8, "topic": 1.0}
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    """White-space separated tokens."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic: one of 16 classes of the text's leading keyword (its first run of five ASCII letters or more)."""
    keyword = F.lower(F.regexp_extract(text, "[A-Za-z]{5,}", 0))
    return F.when(text.isNull() | (keyword == ""), "none").otherwise(F.concat(F.lit("t"), F.substring(F.md5(keyword), 1, 1)))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Default targets: each value's share of the tokens to a power, scaled to sum 1."""
    shares = stored(cells.groupBy(margin).agg(F.pow(F.sum("w"), F.lit(power)).alias("target")), "mix-target")
    total = shares.agg(F.sum("target")).first()[0] or 1.0
    return shares.select(margin, (F.col("target") / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """The cells (source, lang, topic, w) with a factor f_<margin> and a target t_<margin> for each margin; targets: by margin, its values and their target.

    A margin's sums are windows over the cells that share a value, so a sweep over all margins is one job and one small table."""
    raked = cells
    for m in MARGINS:
        raked = raked.join(targets[m].select(m, F.col("target").alias(f"t_{m}")), m, "left").withColumn(f"f_{m}", F.lit(1.0))
    for _ in range(sweeps):
        for m in MARGINS:
            a, b = (F.col(f"f_{x}") for x in MARGINS if x != m)
            total = F.sum(F.col("w") * a * b).over(Window.partitionBy(m))
            raked = raked.withColumn("_s", total).withColumn(f"f_{m}", F.when(F.col("_s") > 0, F.coalesce(F.col(f"t_{m}") / F.col("_s"), F.lit(1.0))).otherwise(F.lit(1.0))).drop("_s")
        raked = stored(raked, "mix-sweep")
    return raked


def residuals(raked: DataFrame) -> DataFrame:
    """How far each margin's sums are from its targets after raking: margin, residual (the largest difference)."""
    weight = F.col("w") * F.col("f_source") * F.col("f_lang") * F.col("f_topic")
    long = raked.select(F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value"), F.col(f"t_{m}").alias("target"), weight.alias("x")) for m in MARGINS])).alias("r")).select("r.*")
    sums = long.where("target IS NOT NULL").groupBy("margin", "value").agg(F.sum("x").alias("x"), F.first("target").alias("target"))
    return sums.groupBy("margin").agg(F.max(F.abs(F.col("x") - F.col("target"))).alias("residual"))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topic_of: Column | None = None, to: str = "mix") -> DataFrame:
    """The documents with one more column ``to``: struct<source, lang, topic, n_tokens, weight, probability, sampled>."""
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = F.struct(value(column(docs, source)).alias("source"), value(column(docs, lang)).alias("lang"), value(topic(column(docs, text)) if topic_of is None else topic_of).alias("topic"), tokens(column(docs, text)).alias("n_tokens"))
    sums = stored(docs.select(keys.alias("k")).groupBy("k.source", "k.lang", "k.topic").agg(F.sum("k.n_tokens").alias("tokens")), "mix-cells")
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    cells = sums.select(*MARGINS, (F.col("tokens") / F.lit(float(total))).alias("w"))
    targets = targets or {m: tempered(cells, m, TEMPERATURE[m]) for m in MARGINS}
    weight = F.col("f_source") * F.col("f_lang") * F.col("f_topic")
    weights = stored(rake(cells, targets).select(F.struct(*MARGINS).alias("cell"), weight.alias("weight")), "mix-weights")
    most = weights.agg(F.max("weight")).first()[0] or 1.0
    every = docs.select(F.struct(*columns(docs)).alias("row"), keys.alias("k"))
    joined = every.join(weights, F.struct("k.source", "k.lang", "k.topic") == F.col("cell"), "left")
    probability = F.round(F.col("weight") / F.lit(most), 6)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("row").getField(doc_id).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    mix = F.struct("k.*", F.round("weight", 6).alias("weight"), probability.alias("probability"), (draw < probability).alias("sampled"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != to.lower()], mix.alias(to))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, its probability and whether it is sampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).select("doc_id", "mix.*")


def _sql() -> str:
    value = {m: f"coalesce({m}, '')" for m in ("source", "lang")}
    word = r"[^\x20\x09-\x0D]+"
    parts = [
        f"""d AS (SELECT doc_id, {value["source"]} source, {value["lang"]} lang,
    CASE WHEN text IS NULL OR regexp_extract(text, '[A-Za-z]{{5,}}') = '' THEN 'none' ELSE 't' || substr(md5(lower(regexp_extract(text, '[A-Za-z]{{5,}}'))), 1, 1) END topic,
    CAST(coalesce(len(regexp_extract_all(text, '{word}')), 0) AS BIGINT) n_tokens FROM documents)""",
        "s AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) tokens FROM d GROUP BY ALL)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, tokens / CAST((SELECT sum(tokens) FROM s) AS DOUBLE) w FROM s)",
    ]
    last = {}
    for m in MARGINS:
        parts.append(f"p_{m} AS (SELECT {m}, pow(sum(w), {TEMPERATURE[m]}) p FROM cells GROUP BY {m})")
        parts.append(f"t_{m} AS MATERIALIZED (SELECT {m}, p / (SELECT sum(p) FROM p_{m}) target, 1.0::DOUBLE f FROM p_{m})")
        last[m] = f"t_{m}"
    for i in range(SWEEPS):
        for m in MARGINS:
            a, b = (x for x in MARGINS if x != m)
            parts.append(
                f"f{i}_{m} AS MATERIALIZED (SELECT t.{m}, CASE WHEN x.s > 0 THEN t.target / x.s ELSE 1.0 END f FROM t_{m} t LEFT JOIN "
                f"(SELECT {m}, sum(w * {a}_.f * {b}_.f) s FROM cells JOIN {last[a]} {a}_ USING ({a}) JOIN {last[b]} {b}_ USING ({b}) GROUP BY {m}) x USING ({m}))"
            )
            last[m] = f"f{i}_{m}"
    parts.append(f"g AS MATERIALIZED (SELECT source, lang, topic, a.f * b.f * c.f weight FROM cells JOIN {last['source']} a USING (source) JOIN {last['lang']} b USING (lang) JOIN {last['topic']} c USING (topic))")
    parts.append("o AS (SELECT doc_id, source, lang, topic, n_tokens, weight, round(weight / (SELECT max(weight) FROM g), 6) probability FROM d JOIN g USING (source, lang, topic))")
    draw = f"CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT) / {float(1 << 48)!r}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) weight, probability, {draw} < probability sampled FROM o"


OP8_SQL = _sql()
