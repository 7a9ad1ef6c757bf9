"""Mixing sources to target weights.

Documents are counted by source and exact token length. Each source's budget
(its share of the total) is met by whole passes over the source, then by an
equal part of each length, and at last by a bounded-knapsack dynamic program
over the lengths that are left, so that the budget is met to the token wherever
the lengths allow. Which documents of a length are taken is drawn by a seeded
hash.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sheetloom.llm.bpe import VOCABULARY, count_tokens
from sheetloom.runtime import sized, staged

#: Tokens of a source's budget that are left to the dynamic program.
WINDOW_TOKENS = 1 << 16
#: Hash ranges into which the documents of one source and length are split.
RANGE_BITS = 8


def fit_subset(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW_TOKENS) -> list[int]:
    """How many documents of each length to take, at most counts, so that
    their tokens come as near to budget as possible without passing it."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    part = max(0, budget - window)
    taken = [c * part // total for c in counts]
    left = budget - sum(n * c for n, c in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda j: -lengths[j])
    for j in order:  # what rounding down has left over, the longest first
        if left <= window:
            break
        more = min(counts[j] - taken[j], (left - window) // lengths[j])
        taken[j] += more
        left -= more * lengths[j]
    # reachable sums as bits; a length's documents in parcels of 1, 2, 4, ...; long ones first, so that short ones fill the gaps
    mask = (1 << (left + 1)) - 1
    reach, parcels = 1, []
    for j in order:
        free = min(counts[j] - taken[j], left // lengths[j])
        parcel = 1
        while free > 0 and not reach >> left & 1:
            n = min(parcel, free)
            wider = reach | (reach << n * lengths[j]) & mask
            if wider != reach:
                parcels.append((reach, j, n))
                reach = wider
            free -= n
            parcel *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for before, j, n in reversed(parcels):
        if not before >> at & 1:
            taken[j] += n
            at -= n * lengths[j]
    return taken


def token_lengths(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of sources with a target.
    Documents without tokens are left out, a doc_id that comes repeatedly
    counts once (as its smallest source and length)."""
    wanted = sized(targets.where("target_share > 0 and max_repeats > 0").select("source").distinct())
    kept = documents.join(wanted, "source", "left_semi").select("doc_id", "source", "text")
    return (
        count_tokens(kept, "text", "n_tokens", path)
        .where("n_tokens > 0")
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "n_tokens")).alias("d"))
        .select("doc_id", "d.source", "d.n_tokens")
    )


def budgets(lengths: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[tuple[str, int, int]]:
    """(source, budget in tokens, max_repeats) of each source that has both a
    target and documents. Without total_tokens the total is the largest at
    which every such source can still give its share (shares taken over the
    sources that have documents); with it, a source gives what it can. Both
    tables here have a row per target, so the driver decides."""
    held = {r.source: r.n for r in lengths.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    goal: dict[str, tuple[float, int]] = {}
    for r in targets.where("target_share > 0 and max_repeats > 0").orderBy("source", "target_share", "max_repeats").collect():
        goal.setdefault(r.source, (r.target_share, r.max_repeats))
    goal = {s: g for s, g in goal.items() if held.get(s)}
    whole = math.fsum(share for share, _ in goal.values())
    if not goal or whole <= 0:
        return []
    if total_tokens is None:
        total_tokens = min(int(held[s] * most * whole / share) for s, (share, most) in goal.items())
    return [(s, min(held[s] * most, round(total_tokens * share / whole)), most) for s, (share, most) in sorted(goal.items())]


def mix_sources(lengths: DataFrame, targets: DataFrame, seed: int = 0, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents that are used, from
    the output of token_lengths. No document is used more often than its
    source's max_repeats. Empty tables give an empty mix."""
    spark = lengths.sparkSession
    rows = budgets(lengths, targets, total_tokens)
    plan_of = spark.createDataFrame(rows, "source string, budget long, max_repeats int")
    counts = lengths.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        # one row per exact length of the source
        pdf = pdf.sort_values("n_tokens")
        n, c = pdf.n_tokens.tolist(), pdf.n.tolist()
        budget, most = int(pdf.budget.iloc[0]), int(pdf.max_repeats.iloc[0])
        held = sum(a * b for a, b in zip(n, c, strict=True))
        passes = min(budget // held, most)
        extra = fit_subset(n, c, budget - passes * held) if passes < most else [0] * len(n)
        return pd.DataFrame({"source": pdf.source, "n_tokens": pdf.n_tokens, "n": pdf.n, "passes": passes, "extra": extra})

    plan = counts.join(F.broadcast(plan_of), "source").groupBy("source").applyInPandas(fit, "source string, n_tokens long, n long, passes long, extra long")
    plan = staged(plan.where("passes > 0 or extra > 0"), "mix-plan")
    docs = lengths.join(sized(plan), ["source", "n_tokens"])
    whole = docs.where("extra = 0 or extra = n").select("doc_id", "source", "n_tokens", (F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("repeats"))
    # a seeded draw of `extra` of the n documents: whole hash ranges below the cut, ranks only inside the one range the cut falls into
    part = docs.where("extra > 0 and extra < n").withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    part = part.withColumn("bin", F.shiftrightunsigned("h", 64 - RANGE_BITS))
    key = ["source", "n_tokens"]
    bins = part.groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    upto = F.sum("in_bin").over(W.Window.partitionBy(*key).orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(upto, F.lit(0))).withColumnRenamed("in_bin", "width")
    part = part.join(bins, [*key, "bin"])
    sure = part.where("before + width <= extra").withColumn("one", F.lit(1))
    cut = part.where("before < extra and before + width > extra")
    rank = F.row_number().over(W.Window.partitionBy(*key, "bin").orderBy("h", "doc_id"))
    cut = cut.withColumn("one", F.when(F.col("before") + rank <= F.col("extra"), 1).otherwise(0))
    rest = part.where("before >= extra").withColumn("one", F.lit(0))
    drawn = sure.unionByName(cut).unionByName(rest).select("doc_id", *key, (F.col("passes") + F.col("one")).alias("repeats"))
    return whole.unionByName(drawn).where("repeats > 0").select("doc_id", "source", "n_tokens", F.col("repeats").cast("int").alias("repeats"))


def mix_report(mixed: DataFrame, targets: DataFrame, lengths: DataFrame | None = None, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, actual_share,
    most_repeats) of every target, those without documents included. With the
    output of token_lengths also (tokens_held, total_tokens, total_held,
    missed): what the source holds, what the mix reaches of all tokens held,
    and by how many tokens the source's budget was missed."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats")
    )
    total = used.agg(F.sum("tokens").alias("total"))  # one row
    out = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").crossJoin(F.broadcast(total))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_repeats")]
    share = F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share")
    if lengths is None:
        return out.select("source", "target_share", "max_repeats", *zero, share)
    held = lengths.groupBy("source").agg(F.sum("n_tokens").alias("tokens_held"))
    out = out.join(F.broadcast(held), "source", "left").crossJoin(F.broadcast(held.agg(F.sum("tokens_held").alias("total_held"))))
    plan = lengths.sparkSession.createDataFrame([(s, b) for s, b, _ in budgets(lengths, targets, total_tokens)], "source string, budget long")
    out = out.join(F.broadcast(plan), "source", "left").withColumn("missed", F.coalesce(F.col("budget"), F.lit(0)) - F.coalesce("tokens", F.lit(0)))
    more = [F.coalesce(c, F.lit(0)).alias(n) for n, c in (("tokens_held", "tokens_held"), ("total_tokens", "total"), ("total_held", "total_held"))]
    return out.select("source", "target_share", "max_repeats", *zero, share, *more, "missed")
