"""Mixing sources to target weights, with DataFrame functions only.

Token shares p of the sources are raised to an exponent t and normalised. t is the largest exponent whose
weights reach the target entropy, but not so small that one source would be repeated over ``max_repeats``
times as often as another. The weights are realised as budgeted block permutations: a source with quota q and
T tokens gives floor(q / T) whole epochs and the beginning of one more; each epoch is a permutation of its own
(by a salted hash), dealt in blocks by the leading hash digits, and the last one is cut where the quota ends.

Defined cases: a null source is a source of its own; null or empty texts and sources without any word count no
tokens and are kept once; rows that repeat an id share its place in the permutation and come or go together;
an empty table gives an empty result; other columns are kept, those named like a column that is made (MADE) with
``_input`` appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexmill.llm.common import free_names
from lexmill.session import cut

MADE = ("mix_epoch", "mix_block", "mix_weight")
WORD = "[^\\x20\\x09-\\x0D]+"
#: Hash digits that each level of blocks adds, and the number of levels.
DIGITS, LEVELS = 2, 3
#: The exponent's interval is cut into FAN parts, ROUNDS times: 48 halvings.
FAN, ROUNDS = 64, 8
#: Bytes of a per-source plan up to which it is broadcast; beyond that it is joined by shuffles.
BROADCAST_BYTES = 8 << 20


def _sent(sources: DataFrame, name: str = "source") -> DataFrame:
    """``sources``, written and to be broadcast if its measured size allows that, so that documents need not move."""
    sources = cut(sources)
    size = sources.agg(F.sum(F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + F.lit(128)).cast("long")).first()[0] or 0
    return F.broadcast(sources) if size <= BROADCAST_BYTES else sources


def _place(seed: str, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in the permutation of one epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float) -> float:
    """Bisect the exponent over ``sources(share)``; only sums for FAN exponents reach the driver."""
    n = sources.count()
    if n < 2:
        return 1.0
    need = target_entropy * float(sources.agg(F.log(F.count("*").cast("double"))).first()[0])
    lo, hi = 0.0, 1.0
    for i in range(ROUNDS + 1):
        at = [1.0] if not i else [lo + k * (hi - lo) / FAN for k in range(1, FAN)]
        power = F.pow("share", "t")
        sums = (
            sources.withColumn("t", F.explode(F.array(*map(F.lit, at))))
            .groupBy("t")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(F.pow("share", F.col("t") - 1)).alias("most"), F.min(F.pow("share", F.col("t") - 1)).alias("least"))
            .select("t", (F.log("z") - F.col("t") * F.col("l") / F.col("z")).alias("entropy"), (F.col("most") / F.col("least")).alias("repeats"))
            .collect()
        )
        past = [r.t for r in sums if r.entropy < need and r.repeats <= max_repeats]
        if not i:
            if not past:
                return 1.0
            continue
        hi = min([hi, *past])
        lo = max([lo, *(r.t for r in sums if r.t < hi)])
    return hi


def plan(docs: DataFrame, *, target_entropy: float = 0.97, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """One row per source: source, tokens, weight, quota, epochs, cut (the last place that the partial epoch holds).

    ``target_entropy`` is a share of the greatest entropy, ln(number of sources). Without ``budget`` the budget
    is the least that leaves no document out.
    """
    slim = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")))
    sums = cut(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    live = sums.filter("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0] or 1
    share = F.col("tokens").cast("double") / F.lit(float(total))
    t = exponent(live.select(share.alias("share")), target_entropy, max_repeats)
    z = live.agg(F.sum(F.pow(share, F.lit(t)))).first()[0] or 1.0
    weights = sums.withColumn("weight", F.when(F.col("tokens") > 0, F.round(F.pow(share, F.lit(t)) / F.lit(z), 9)).otherwise(F.lit(0.0)))
    whole = budget is None
    if whole:
        budget = weights.filter("weight > 0").agg(F.max(F.ceil(F.col("tokens") / F.col("weight")))).first()[0] or 0
    quota = F.floor(F.col("weight") * F.lit(float(budget))).cast("long")
    quotas = weights.withColumn("quota", F.greatest(quota, "tokens") if whole else quota).withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
    )
    quotas = cut(quotas.withColumn("left", F.col("quota") - F.col("epochs") * F.col("tokens")))
    partial = _sent(quotas.filter("left > 0").select(F.col("source").alias("s"), "epochs", "left"), "s")
    rest = slim.join(partial, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "n_tokens", "left", _place(seed, F.col("epochs") + 1, F.col("doc_id")).alias("place")
    )
    ends = _ends(rest)
    return quotas.join(ends, quotas["source"].eqNullSafe(ends["s"]), "left").select(quotas["source"], "tokens", "weight", "quota", "epochs", "cut")


def _ends(rest: DataFrame) -> DataFrame:
    """For each source the last place whose running tokens stay within ``left``.

    Blocks are summed first and only the block in which the quota ends is opened, so no task sees a whole source.
    """
    for level in range(1, LEVELS + 1):
        block = F.substring("place", 1, level * DIGITS)
        runs = rest.groupBy("source", block.alias("block")).agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"))
        runs = runs.withColumn("run", F.sum("n").over(W.partitionBy("source").orderBy("block")))
        ends = runs.filter("run > left").groupBy(F.col("source").alias("s")).agg(F.min(F.struct("block", (F.col("left") - F.col("run") + F.col("n")).alias("left"))).alias("end"))
        ends = ends.select("s", "end.block", F.col("end.left").alias("still"))
        rest = rest.join(ends, F.col("source").eqNullSafe(F.col("s")) & (block == F.col("block"))).select("source", "n_tokens", F.col("still").alias("left"), "place")
    # places are hex digits: what sorts before the open block's first place is within the quota
    runs = rest.withColumn("run", F.sum("n_tokens").over(W.partitionBy("source").orderBy("place")))
    inside = F.max(F.when(F.col("run") <= F.col("left"), F.col("place")))
    return runs.groupBy(F.col("source").alias("s")).agg(F.coalesce(inside, F.substring(F.min("place"), 1, LEVELS * DIGITS)).alias("cut"))


def realise(docs: DataFrame, mix: DataFrame, seed: str = "mix") -> DataFrame:
    """Rows of ``docs`` once per epoch that holds them, with epoch, block and weight; other columns stay as they are."""
    docs, _ = free_names(docs, (*MADE, "mix_plan"))
    named = _sent(mix.select(F.struct("source", "weight", "epochs", "cut").alias("mix_plan")), "mix_plan.source")
    joined = docs.join(named, docs["source"].eqNullSafe(F.col("mix_plan.source")))
    extra = F.coalesce(_place(seed, F.col("mix_plan.epochs") + 1, F.col("doc_id")) <= F.col("mix_plan.cut"), F.lit(False))
    copies = F.col("mix_plan.epochs") + extra.cast("long")
    out = joined.filter(copies > 0).select(*(docs[c] for c in docs.columns), F.col("mix_plan"), F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("mix_epoch"))
    return out.withColumn("mix_block", F.substring(_place(seed, F.col("mix_epoch"), F.col("doc_id")), 1, DIGITS)).withColumn("mix_weight", F.col("mix_plan.weight")).drop("mix_plan")


def mix_sources(docs: DataFrame, *, target_entropy: float = 0.97, max_repeats: float = 4.0, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """The columns of ``docs`` and mix_epoch, mix_block (order within the epoch), mix_weight."""
    return realise(docs, plan(docs, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget, seed=seed), seed)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source),
p AS (SELECT tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM s) AS share FROM s WHERE tokens > 0),
b(i, lo, hi) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN past THEN lo ELSE mid END, CASE WHEN past THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(share, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(share, (lo + hi) / 2) * ln(share)) / sum(pow(share, (lo + hi) / 2)) < 0.97 * ln(count(*)::DOUBLE)
          AND max(pow(share, (lo + hi) / 2 - 1)) / min(pow(share, (lo + hi) / 2 - 1)) <= 4 FROM p) AS past
    FROM b WHERE i < 48) AS x),
t AS (SELECT CASE WHEN (SELECT -sum(share * ln(share)) < 0.97 * ln(count(*)::DOUBLE) FROM p) THEN hi ELSE 1 END AS t FROM b WHERE i = 48),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens::DOUBLE / (SELECT sum(tokens)::DOUBLE FROM s), (SELECT t FROM t)) / (SELECT sum(pow(share, (SELECT t FROM t))) FROM p), 9) ELSE 0 END AS weight FROM s),
q AS (SELECT *, greatest(floor(weight * (SELECT max(ceil(tokens / weight)) FROM w WHERE weight > 0))::BIGINT, tokens) AS quota FROM w),
e AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS epochs FROM q),
r AS (SELECT d.doc_id, d.source, d.n, e.weight, e.epochs, e.quota - e.epochs * e.tokens AS rest,
  sum(d.n) OVER (PARTITION BY d.source ORDER BY md5('mix:' || (e.epochs + 1) || ':' || coalesce(d.doc_id::VARCHAR, 'null'))) AS run
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, epochs + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, source, n AS n_tokens, g.epoch::BIGINT AS mix_epoch, substr(md5('mix:' || g.epoch || ':' || coalesce(doc_id::VARCHAR, 'null')), 1, 2) AS mix_block, weight AS mix_weight
FROM c, LATERAL (SELECT unnest(range(1, (copies + 1)::BIGINT)) AS epoch) AS g
"""
