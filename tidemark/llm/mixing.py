"""Sampling documents so that tokens meet target shares of source, language and topic (raking)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemark.llm.training import free_name
from tidemark.session import stored_copy

# Raking ends when no weight changes by more than this in a round, at the latest after ROUNDS; a mix ends sooner.
ROUNDS = 40
TOLERANCE = 1e-9
MIX_TOLERANCE = 1e-5
# Cells raked in one task; more are dealt to as many tasks as their number asks for.
TASK_CELLS = 1 << 15
# Targets: shares in proportion to tokens to this power, and the part of all tokens to keep.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}
KEEP = 0.5
DIMENSIONS = ("source", "lang", "topic")

# The text runs unchanged in Spark and in the checking engine. A topic is the form of a text, told by marks.
TOPIC = """CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty'
 WHEN 20 * (length(text) - length(replace(text, '|', ''))) >= length(text) THEN 'table'
 WHEN 20 * (length(text) - length(replace(text, '!', ''))) >= length(text) THEN 'shout'
 WHEN 100 * (length(text) - length(replace(text, chr(10), ''))) >= length(text) THEN 'list'
 WHEN length(text) < 400 THEN 'note' ELSE 'prose' END"""
TOKENS = "CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 0 ELSE 1 + length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) END"


def uniform(key: Column, seed: int = 7) -> Column:
    """A number from 0 to 1 that depends on the key alone; a null key counts as an empty one."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def _wanted(sums: DataFrame, name: str, power: float, shares: Mapping[str, float] | None) -> DataFrame:
    """Adds each value's wanted share: as given, or in proportion to its tokens to a power. Values that are
    not named divide what the named ones leave in proportion to their tokens."""
    if not shares:
        part = F.pow("t", F.lit(power))
        return sums.withColumn("wanted", part / F.lit(sums.agg(F.sum(part)).first()[0]))
    rest = 1 - sum(shares.values())
    if rest < -1e-9 or not all(0 <= x <= 1 for x in shares.values()):
        raise ValueError(f"shares of {name} must lie between 0 and 1 and sum to 1 at most")
    own = F.element_at(F.create_map(*(F.lit(x) for v, share in shares.items() for x in (v, float(share)))), F.col("value"))
    present = {r[0] for r in sums.where(own.isNotNull()).select("value").collect()}  # as many as named at most
    absent = sorted(v for v, share in shares.items() if share > 0 and v not in present)
    others = sums.agg(F.sum(F.when(own.isNull(), F.col("t")))).first()[0]
    if absent or rest > 1e-9 and not others:
        raise ValueError(f"no tokens of {name} {absent}" if absent else f"shares of {name} sum to {1 - rest} and there is no other value")
    return sums.withColumn("wanted", F.coalesce(own, F.lit(max(rest, 0.0)) * F.col("t") / F.lit(others)))


def _targets(sums: DataFrame, mass: float) -> DataFrame:
    """Adds target: wanted shares times one factor, at most what a value has, so that they sum to ``mass``."""
    factor = mass
    while True:
        full = F.col("wanted") * factor >= F.col("most")
        held, free = sums.where("wanted > 0").agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("wanted")))).first()
        larger = (mass - (held or 0.0)) / free if free else float("inf")
        if larger <= factor * (1 + 1e-12):
            break
        factor = larger
        if not free:
            break
    return sums.withColumn("target", F.when(F.col("wanted") > 0, F.least(F.col("wanted") * factor, "most")).otherwise(0.0))


def rake(cells: DataFrame, powers: Mapping[str, float] = POWERS, rounds: int = ROUNDS, shares: Mapping[str, Mapping[str, float]] | None = None,
         keep: float | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with a weight whose sums meet every marginal target.

    ``shares`` gives wanted shares by dimension and value, such as {"lang": {"en": 0.6}}; a value that is
    named with a share and has no tokens is an error. A dimension without them wants its tokens to its power
    in ``powers``. Where ``keep``, the part of all tokens to sample, is given, no value's target and no cell's
    weight exceeds what all its tokens make up of the sample; the others are raised by one factor instead.
    Each round scales the weights to the source, then the language, then the topic targets, then cuts them
    at that bound, so the next round hands on what was cut. It ends when no weight changes by more than
    ``tolerance``, at the latest after ``rounds``. Where cells that are absent or too small make targets
    impossible, sums stay apart; ``reached_shares`` shows how far. Cells are as many as combinations of values;
    each round is written out, in a task for every TASK_CELLS of them. Where one task holds them all, a round
    needs no shuffle, so its cost doesn't follow the session's number of partitions. Further columns: wanted_
    and target_ of each dimension.
    """
    total, n = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, tasks = float(total or 0), max(1, -(-n // TASK_CELLS))
    most = F.col("t") / F.lit(keep * total) if keep and total else F.lit(float("inf"))
    sums, mass = {}, 1.0
    for name in DIMENSIONS if total else ():
        found = stored_copy(cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("t")).coalesce(tasks), "sums")
        sums[name] = _wanted(found, name, powers.get(name, 1.0), (shares or {}).get(name)).withColumn("most", most)
        mass = min(mass, sums[name].where("wanted > 0").agg(F.sum("most")).first()[0])
    state = cells.withColumns({"t": F.col("tokens").cast("double"), "weight": F.col("tokens") / F.lit(total or 1.0)}).withColumn("most", most)
    for name in DIMENSIONS:
        if not total:
            state = state.withColumns({f"wanted_{name}": F.lit(0.0), f"target_{name}": F.lit(0.0)})
            continue
        shared = _targets(sums[name], mass).select(F.col("value").alias("_v"), F.col("wanted").alias(f"wanted_{name}"), F.col("target").alias(f"target_{name}"))
        state = state.join(shared, state[name] == F.col("_v")).drop("_v")
    state = stored_copy(state.coalesce(tasks), "cells").coalesce(tasks)
    for _ in range(rounds if total else 0):
        state = state.withColumn("before", F.col("weight"))
        for name in DIMENSIONS:
            by_value = state.groupBy(F.col(name).alias("_v")).agg(F.sum("weight").alias("_s"))
            scaled = F.when(F.col("_s") > 0, F.col("weight") * F.col(f"target_{name}") / F.col("_s")).otherwise(0.0)
            state = state.join(by_value, state[name] == F.col("_v")).withColumn("weight", scaled).drop("_v", "_s")
        seen = Observation()
        state = state.withColumn("weight", F.least("weight", "most")).coalesce(tasks)
        state = state.observe(seen, F.max(F.abs(F.col("weight") - F.col("before"))).alias("change")).drop("before")
        state = stored_copy(state, "raked").coalesce(tasks)
        if seen.get["change"] <= tolerance:
            break
    return state.drop("t", "most")


def reached_shares(raked: DataFrame) -> DataFrame:
    """What raking came to: dimension, value, tokens, wanted and target share, and the share reached."""
    found = [raked.groupBy(F.lit(name).alias("dimension"), F.col(name).alias("value")).agg(
        F.sum("tokens").alias("tokens"), F.first(f"wanted_{name}").alias("wanted"), F.first(f"target_{name}").alias("target"),
        F.sum("weight").alias("reached")) for name in DIMENSIONS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                  powers: Mapping[str, float] = POWERS, keep: float = KEEP, rounds: int = ROUNDS, seed: int = 7,
                  shares: Mapping[str, Mapping[str, float]] | None = None, topic_col: str | None = None,
                  tolerance: float = MIX_TOLERANCE) -> DataFrame:
    """The rows with topic, n_tokens, weight (a cell's share of the mix), probability and sampled.

    Targets come from ``shares`` or ``powers``, ``rounds`` and ``tolerance`` end the raking, see ``rake``; ``keep`` (over 0, at most 1) is the part of all
    tokens to sample. The topic is that of ``topic_col``, or else the form of the text. A cell's probability is
    keep * weight * all tokens / its tokens, so expected tokens follow the raked weights. sampled compares it
    with a number drawn from the id. Null source, language or topic counts as 'none'. Texts without tokens
    have weight and probability 0 and are never sampled. Rows that repeat an id are sampled alike; a long text
    counts as a whole. Columns of the five names are replaced, others pass through. An empty table gives no
    rows.
    """
    if not 0 < keep <= 1:
        raise ValueError("keep lies over 0 and is 1 at most")
    made = ["topic", "n_tokens", "weight", "probability", "sampled"]
    base = [c for c in docs.columns if c not in made]
    source, lang, topic, s, g, t = (free_name(docs, x) for x in ("mix_source", "mix_lang", "mix_topic", "cell_source", "cell_lang", "cell_topic"))
    none = F.lit("none")
    rows = docs.withColumns({
        topic: F.expr(TOPIC.replace("text", f"`{text_col}`")) if topic_col is None else F.coalesce(F.col(topic_col).cast("string"), none),
        source: F.coalesce(F.col(source_col).cast("string"), none), lang: F.coalesce(F.col(lang_col).cast("string"), none)})
    rows = rows.drop(*made).withColumn("n_tokens", F.expr(TOKENS.replace("text", f"`{text_col}`")).cast("long"))
    cells = rows.where("n_tokens > 0").groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(topic).alias("topic")).agg(
        F.sum("n_tokens").alias("tokens"))
    cells = stored_copy(cells, "cells")
    every = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    raked = rake(cells, powers, rounds, shares, keep, tolerance)
    rates = raked.select(F.col("source").alias(s), F.col("lang").alias(g), F.col("topic").alias(t), "weight",
                         F.least(F.lit(1.0), F.lit(keep) * F.col("weight") * F.lit(every) / F.col("tokens")).alias("probability"))
    joined = rows.join(rates, (F.col(source) == F.col(s)) & (F.col(lang) == F.col(g)) & (F.col(topic) == F.col(t)) & (F.col("n_tokens") > 0), "left")
    joined = joined.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))})
    joined = joined.withColumn("sampled", uniform(F.col(id_col), seed) < F.col("probability"))
    return joined.withColumn("topic", F.col(topic)).select(*(F.col(f"`{c}`") for c in base), *made)


def _dimension_sql(name: str) -> str:
    """Tables w_, f_ and t_ of a dimension: wanted shares, the factor for each number of full values, targets."""
    order = f"ORDER BY most / wanted, {name} ROWS BETWEEN"
    return f"""w_{name} AS (SELECT {name}, pow(sum(tokens), {POWERS[name]}) / sum(pow(sum(tokens), {POWERS[name]})) OVER () AS wanted,
   sum(tokens) / ({KEEP} * (SELECT sum(tokens) FROM c)) AS most FROM c GROUP BY 1),
f_{name} AS (SELECT (1 - coalesce(sum(most) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(wanted) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM w_{name}),
t_{name} AS (SELECT {name}, least(wanted * (SELECT max(factor) FROM f_{name}), most) AS target_{name} FROM w_{name})"""


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, {TOPIC} AS topic,
   CAST({TOKENS} AS BIGINT) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
{", ".join(_dimension_sql(name) for name in DIMENSIONS)},
r AS (SELECT 0 AS i, c.*, target_source, target_lang, target_topic, tokens / (SELECT sum(tokens) FROM c) AS weight,
   tokens / ({KEEP} * (SELECT sum(tokens) FROM c)) AS most, CAST(1 AS DOUBLE) AS change
   FROM c JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)
 UNION ALL
 SELECT * EXCLUDE (before), max(abs(weight - before)) OVER () FROM (
  SELECT i + 1, source, lang, topic, tokens, target_source, target_lang, target_topic,
    least(weight * target_topic / sum(weight) OVER (PARTITION BY topic), most) AS weight, most, before FROM (
   SELECT * REPLACE (weight * target_lang / sum(weight) OVER (PARTITION BY lang) AS weight) FROM (
    SELECT * REPLACE (weight * target_source / sum(weight) OVER (PARTITION BY source) AS weight), weight AS before FROM r
    WHERE i < {ROUNDS} AND change > {MIX_TOLERANCE})))),
f AS (SELECT source, lang, topic, weight, least(1.0, {KEEP} * weight * (SELECT sum(tokens) FROM c) / tokens) AS probability FROM r
   WHERE i = (SELECT max(i) FROM r)),
j AS (SELECT d.*, coalesce(weight, 0.0) AS weight, coalesce(probability, 0.0) AS probability
   FROM d LEFT JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic AND n_tokens > 0)
SELECT doc_id, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/7'), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 < probability AS sampled
FROM j
"""
