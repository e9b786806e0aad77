"""Mixing sources to target weights by iterative proportional fitting, on DataFrame functions alone.

The token mass of the corpus is summed into cells (one for each combination of the margins' values that occurs).
Raking scales the cells to the target of each margin in turn, again and again; then every document is kept with the
probability of its cell, by a hash of its id, so that the same document always meets the same fate.

No document can be kept more than once. Where the targets ask for that, plain probabilities are clipped at 1 and the
kept shares fall short of the targets; `bounded` rakes under the bound instead (see `rake_bounded`).

Edge cases: a null margin value is a value of its own (''); null and empty texts weigh one token; a null id hashes like
the empty string; rows that repeat are each decided, alike; an empty table gives an empty table; other columns pass
through unchanged: added columns begin with a prefix that no column of the input begins with (see `free_prefix`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir, table, unused

#: Exponent for each margin: targets are the shares of the mass raised to it, so small values gain.
EXPONENTS = {"source": 0.5, "lang": 0.7, "topic": 0.5}
ROUNDS = 6
CLIP_ROUNDS = 4
KEEP_SHARE = 0.5
#: Most cells for which the table of cells is broadcast (under 10 MB); beyond it the join shuffles.
BROADCAST_CELLS = 100_000


def token_weight(text: str = "text") -> Column:
    """Estimated tokens of a text: a quarter of its code points, one at least."""
    return F.greatest(F.lit(1.0), F.ceil(F.coalesce(F.length(text), F.lit(0)) / F.lit(4.0)).cast("double"))


def unit_hash(column: str) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def free_prefix(df: DataFrame, prefix: str = "_mix_") -> str:
    """The prefix, with as many underscores before it as it takes for no column of `df` to begin with it."""
    while any(c.lower().startswith(prefix.lower()) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def _shares(cells: DataFrame, name: str, target: float | DataFrame, mass: str) -> DataFrame:
    """The target of each value of a margin, not normed."""
    if isinstance(target, DataFrame):
        return target.select(F.col("value").alias(name), F.col("share").cast("double").alias(f"_t_{name}"))
    return cells.groupBy(name).agg(F.pow(F.sum(mass), F.lit(float(target))).alias(f"_t_{name}"))


def rake(cells: DataFrame, margins: Mapping[str, float | DataFrame], mass: str = "mass", rounds: int = ROUNDS) -> DataFrame:
    """Add `factor` to each cell so that mass * factor meets the targets of the margins.

    A margin's target is an exponent (shares of the mass raised to it), or a DataFrame (value, share). The last margin
    is met exactly, the others as nearly as the rounds allow.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    total = Window.partitionBy(F.lit(0))
    sums = cells.agg(F.sum(mass).alias("_total"))
    out = cells.withColumn("factor", F.lit(1.0))
    for name, target in margins.items():
        shares = _shares(cells, name, target, mass)
        shares = shares.withColumn(f"_t_{name}", F.col(f"_t_{name}") / F.sum(f"_t_{name}").over(total))
        out = out.join(shares, name, "left").fillna(0.0, [f"_t_{name}"])
    out = out.crossJoin(F.broadcast(sums))  # one row
    for _ in range(rounds):
        for name in margins:
            now = F.sum(F.col(mass) * F.col("factor")).over(Window.partitionBy(name))
            out = out.withColumn("factor", F.when(now > 0, F.col("factor") * F.col(f"_t_{name}") * F.col("_total") / now).otherwise(F.lit(0.0)))
        out = out.checkpoint()  # the cells are few, but a plan of all rounds is large for the driver
    return out.select(*cells.columns, "factor")


def _filled(df: DataFrame, size: str, weight: str, amount: Column, out: str, *by: str) -> DataFrame:
    """Add `out`: weight * level, at most size, with the level of each group at which they add up to `amount`.

    By rising size / weight the rows fill up one after the other; the level is the highest of those at which a row and
    all after it would share what the rows before it leave.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.when(F.col(weight) > 0, F.col(size) / F.col(weight)).asc_nulls_last())
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    levels = df.withColumns({"_before": before, "_rest": rest}).withColumn("_level", F.when(F.col("_rest") > 0, (amount - F.col("_before")) / F.col("_rest")))
    level = F.greatest(F.lit(0.0), F.coalesce(F.max("_level").over(group), F.lit(0.0)))
    return levels.withColumn(out, F.least(F.col(size), F.col(weight) * level)).drop("_before", "_rest", "_level")


def rake_bounded(raked: DataFrame, margins: Mapping[str, float | DataFrame], budget: float, mass: str = "mass", rounds: int = ROUNDS) -> DataFrame:
    """Add `probability` (1 at most) to raked cells, so that the kept mass is `budget` and meets the margins' targets.

    A value whose whole mass is less than its target is kept whole, and the margin's other values share the rest by
    their targets; targets that can be met are met. Each step scales the cells of a value to its amount under the bound.
    """
    out = raked.withColumn("_kept", F.least(F.col(mass), F.col(mass) * F.col("factor")))
    for name, target in margins.items():
        values = raked.groupBy(name).agg(F.sum(mass).alias("_size")).join(_shares(raked, name, target, mass), name, "left").fillna(0.0, [f"_t_{name}"])
        amounts = _filled(values, "_size", f"_t_{name}", F.lit(float(budget)), f"_a_{name}").select(name, f"_a_{name}")
        out = out.join(amounts, name)
    for _ in range(rounds):
        for name in margins:
            out = _filled(out, mass, "_kept", F.col(f"_a_{name}"), "_next", name).withColumn("_kept", F.col("_next")).drop("_next")
        out = out.checkpoint()
    return out.select(*raked.columns, F.least(F.lit(1.0), F.col("_kept") / F.col(mass)).alias("probability"))


def calibrated_mix(df: DataFrame, margins: Mapping[str, Column], targets: Mapping[str, float | DataFrame] | None = None, weight: Column | None = None, keep_share: float = KEEP_SHARE, rounds: int = ROUNDS, id_column: str = "doc_id", prefix: str = "_mix_", bounded: bool = False) -> DataFrame:
    """`df` with `{prefix}factor`, `{prefix}probability` and `{prefix}kept`; the prefix is `free_prefix(df, prefix)`.

    margins: name -> expression. The kept tokens are expected to be `keep_share` of all: probabilities are
    factor * scale, clipped at 1, and the scale is set anew `CLIP_ROUNDS` times for what clipping takes away, at the
    cost of the targets; with `bounded` the cells are raked again under the bound.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    prefix = free_prefix(df, prefix)
    targets = dict(targets or EXPONENTS)
    named = {name: f"{prefix}{name}" for name in margins}
    rows = df.withColumns({named[n]: F.coalesce(c.cast("string"), F.lit("")) for n, c in margins.items()}).withColumn(f"{prefix}weight", weight if weight is not None else token_weight())
    cells = rows.groupBy(*named.values()).agg(F.sum(f"{prefix}weight").alias("mass"))
    raked = rake(cells, {named[n]: targets[n] for n in margins}, rounds=rounds)
    budget, top, count = raked.agg(F.sum("mass") * F.lit(float(keep_share)), F.lit(0.0), F.count(F.lit(1))).first()
    scale = float(keep_share)
    for _ in range(0 if bounded else CLIP_ROUNDS):
        full, rest = raked.agg(F.sum(F.when(F.col("factor") * scale >= 1, F.col("mass"))), F.sum(F.when(F.col("factor") * scale < 1, F.col("mass") * F.col("factor")))).first()
        if rest and budget > (full or 0.0):
            scale = max(scale, (budget - (full or 0.0)) / rest)
    if bounded:
        raked = rake_bounded(raked, {named[n]: targets[n] for n in margins}, budget or 0.0, rounds=rounds)
    probability = F.col("probability") if bounded else F.least(F.lit(1.0), F.col("factor") * F.lit(scale))
    cells = raked.select(*named.values(), F.col("factor").alias(f"{prefix}factor"), probability.alias(f"{prefix}probability"))
    joined = rows.join(F.broadcast(cells) if count <= BROADCAST_CELLS else cells, list(named.values()))
    return joined.withColumn(f"{prefix}kept", unit_hash(id_column) < F.col(f"{prefix}probability"))


def with_topic(docs: DataFrame, embeddings: DataFrame, name: str = "_topic") -> DataFrame:
    """`docs` with a column `name`: the least cluster label of its vector, null without one."""
    key = unused(docs, "_topic_of")
    topics = embeddings.groupBy(F.col("vec_id").alias(key)).agg(F.min("label").cast("string").alias(name))
    return docs.join(topics, F.col("doc_id") == F.col(key), "left").drop(key)


def mix_documents(docs: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """Documents raked over source, language and topic, with the decision of each.

    Texts are weighed before the join with the topics, which then moves them only if the caller wants them back.
    """
    weight, topic = unused(docs, "_topic_weight"), unused(docs, "_topic")
    weighed = with_topic(docs.withColumn(weight, token_weight()), embeddings, topic)
    return calibrated_mix(weighed, {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}, weight=F.col(weight), **options).drop(weight, topic)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf_dir, "embeddings"), bounded=True)
    return mixed.select("doc_id", F.col("_mix_weight").cast("long").alias("n_tokens"), F.col("_mix_topic").alias("topic"), F.round("_mix_factor", 6).alias("factor"), F.round("_mix_probability", 6).alias("probability"), F.col("_mix_kept").alias("kept"))


def mixing_ctes(docs: str, prefix: str = "m_") -> str:
    """CTEs that end in {prefix}decided (all columns of `docs`, n_tokens, topic, factor, probability, kept)."""
    p, names = prefix, ("source", "lang", "topic")
    out = [f"""{p}topics AS (SELECT vec_id, min(label)::VARCHAR AS t FROM embeddings GROUP BY vec_id)""",
           f"""{p}rows AS (SELECT d.*, coalesce(d.source, '') AS m_source, coalesce(d.lang, '') AS m_lang, coalesce(t.t, '') AS m_topic, greatest(1.0::DOUBLE, ceil(coalesce(length(d.text), 0) / 4.0::DOUBLE)) AS w FROM {docs} d LEFT JOIN {p}topics t ON d.doc_id = t.vec_id)""",
           f"""{p}cells AS (SELECT m_source, m_lang, m_topic, sum(w) AS mass FROM {p}rows GROUP BY ALL)""",
           f"""{p}total AS (SELECT sum(mass) AS total FROM {p}cells)"""]
    for n in names:
        out.append(f"{p}t_{n} AS (SELECT m_{n}, x / sum(x) OVER () AS t_{n} FROM (SELECT m_{n}, pow(sum(mass), {EXPONENTS[n]}::DOUBLE) AS x FROM {p}cells GROUP BY m_{n}))")
    out.append(f"{p}f0 AS (SELECT c.*, t_source, t_lang, t_topic, total, 1.0::DOUBLE AS factor FROM {p}cells c JOIN {p}t_source USING (m_source) JOIN {p}t_lang USING (m_lang) JOIN {p}t_topic USING (m_topic) CROSS JOIN {p}total)")
    k = 0
    for _ in range(ROUNDS):
        for n in names:
            out.append(f"{p}f{k + 1} AS MATERIALIZED (SELECT * REPLACE (factor * t_{n} * total / sum(mass * factor) OVER (PARTITION BY m_{n}) AS factor) FROM {p}f{k})")
            k += 1
    def filled(rows: str, size: str, weight: str, amount: str, name: str, by: str = "") -> str:
        """`rows` with `name`: weight * level, at most size, so that they add up to `amount` in each group."""
        group = f"PARTITION BY {by}" if by else ""
        order = f"({group} ORDER BY CASE WHEN {weight} > 0 THEN {size} / {weight} END NULLS LAST ROWS BETWEEN"
        levels = f"SELECT *, coalesce(sum({size}) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum({weight}) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {rows}"
        top = f"SELECT *, greatest(0, coalesce(max(CASE WHEN rest > 0 THEN ({amount} - held) / rest END) OVER ({group}), 0)) AS level FROM ({levels})"
        return f"SELECT * EXCLUDE (held, rest, level), least({size}, {weight} * level) AS {name} FROM ({top})"

    out.append(f"{p}budget AS (SELECT sum(mass) * {KEEP_SHARE}::DOUBLE AS budget FROM {p}cells)")
    for n in names:
        sizes = f"(SELECT m_{n}, sum(mass) AS size, any_value(t_{n}) AS target, any_value(budget) AS budget FROM {p}f{k} CROSS JOIN {p}budget GROUP BY m_{n})"
        out.append(f"{p}a_{n} AS MATERIALIZED (SELECT m_{n}, a_{n} FROM ({filled(sizes, 'size', 'target', 'budget', f'a_{n}')}))")
    out.append(f"{p}k0 AS MATERIALIZED (SELECT f.*, a_source, a_lang, a_topic, least(mass, mass * factor) AS held_mass FROM {p}f{k} f JOIN {p}a_source USING (m_source) JOIN {p}a_lang USING (m_lang) JOIN {p}a_topic USING (m_topic))")
    j = 0
    for _ in range(ROUNDS):
        for n in names:
            out.append(f"{p}k{j + 1} AS MATERIALIZED (SELECT * EXCLUDE (held_mass, next_mass), next_mass AS held_mass FROM ({filled(f'{p}k{j}', 'mass', 'held_mass', f'a_{n}', 'next_mass', f'm_{n}')}))")
            j += 1
    out.append(f"""{p}decided AS (SELECT r.* EXCLUDE (m_source, m_lang, m_topic, w), w::BIGINT AS n_tokens, r.m_topic AS topic, factor, least(1.0, held_mass / mass) AS probability,
        (('0x' || substr(md5(coalesce(r.doc_id::VARCHAR, '')), 1, 8))::UBIGINT)::DOUBLE / 4294967296.0::DOUBLE < least(1.0, held_mass / mass) AS kept FROM {p}rows r JOIN {p}k{j} f USING (m_source, m_lang, m_topic))""")
    return ",\n".join(out)


OP10_SQL = f"WITH {mixing_ctes('documents')}\nSELECT doc_id, n_tokens, topic, round(factor, 6) AS factor, round(probability, 6) AS probability, kept FROM m_decided"
