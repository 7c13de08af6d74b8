"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic) are raked until their
sums meet the target shares of each of the three marginals; no cell may ask
for more tokens than it has. Up to ``DRIVER_CELLS`` cells are raked on the driver, larger tables by the
same steps in Spark: a grouped sum a marginal, a written table a round. A cell's calibrated probability is the raked over
the present weight, and each document is drawn by the hash of its id.

Defined cases: null source, language or topic is a category of its own;
null and empty texts have no tokens and fall in their cell; only if ``max_categories`` is
given are smaller categories without a stated target pooled as ``(other)``; rows
with equal ids share one draw; an empty table gives an empty result; columns named as the results are replaced,
others stay. Targets that no weights within the present tokens can meet are not met in silence: ``residuals`` tells
what each category lacks, and ``mixture(strict=True)`` refuses. ``topic`` is the form of a text unless the caller names a column of topics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import write_shared

MARGINS = ("source", "lang", "topic")
DRIVER_CELLS = 20_000
#: Targets are shares raised to this power: large categories give way to small ones.
TEMPER = 0.7
#: Part of all tokens that the mixture holds.
BUDGET = 0.7
OTHER, NULL = "(other)", "(null)"


def n_tokens(text: str = "text") -> Column:
    """Whitespace-separated tokens; none in a null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0))


def topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    """The form of a text as its topic: table, listing, legal, note, article or book."""
    text_c, n = F.col(text), F.col(tokens)
    pipes = F.length(text_c) - F.length(F.translate(text_c, "|", ""))
    breaks = F.length(text_c) - F.length(F.translate(text_c, "\n", ""))
    return (
        F.when(n == 0, "empty")
        .when(pipes * 10 >= n, "table")
        .when(breaks * 8 >= n, "listing")
        .when(text_c.contains("License"), "legal")
        .when(n < 120, "note")
        .when(n < 1200, "article")
        .otherwise("book")
    )


def rake(present: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Cell weights that sum to ``budget``, meet the target shares of every axis and stay within ``present``."""
    codes = [c.ravel() for c in np.indices(present.shape)]
    return rake_cells(present.ravel(), codes, targets, budget, rounds, tolerance).reshape(present.shape)


def rake_cells(present: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """``rake`` of a list of cells; ``codes`` has the category numbers of each axis."""
    cells = present.astype(float) * (budget / max(present.sum(), 1e-300))
    for _ in range(rounds):
        before = cells
        for code, share in zip(codes, targets, strict=True):
            have = np.bincount(code, cells, len(share))
            factor = np.divide(share * budget, have, out=np.zeros_like(have), where=have > 0)
            cells = np.minimum(cells * factor[code], present)
        if np.abs(cells - before).max() <= tolerance * max(budget, 1.0):
            break
    return cells


def rake_table(cells: DataFrame, budget: float, temper: float, targets: dict[str, dict[str, float]] | None, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``cell_probabilities`` of a cell table in Spark: (_m_source, _m_lang, _m_topic, weight, probability)."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    asked = budget * total
    shares = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("own"))
        given = (targets or {}).get(m)
        if given is None:
            wanted = own.select(m, F.when(F.col("own") > 0, F.pow("own", F.lit(float(temper)))).otherwise(0.0).alias("wanted"))
        else:
            stated = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in given.items()], f"{m} string, stated double")
            wanted = own.join(stated, m, "left").select(m, F.when(F.col("own") > 0, F.coalesce("stated", F.lit(0.0))).otherwise(0.0).alias("wanted"))
        wanted = write_shared(wanted, "mixing-targets")
        scale = max(float(wanted.agg(F.sum("wanted")).first()[0] or 0), 1e-300)
        shares[m] = wanted.select(m, (F.col("wanted") / scale * asked).alias("goal"))
    now = cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens")).withColumn("cell", F.col("tokens") * (asked / max(total, 1e-300)))
    for _ in range(rounds):
        now = now.withColumn("before", F.col("cell"))
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum("cell").alias("have")).join(shares[m], m).select(m, F.when(F.col("have") > 0, F.col("goal") / F.col("have")).otherwise(0.0).alias("factor"))
            now = now.join(factor, m).withColumn("cell", F.least(F.col("cell") * F.col("factor"), F.col("tokens"))).drop("factor")
        now = write_shared(now, "mixing-round")
        if now.agg(F.max(F.abs(F.col("cell") - F.col("before")))).first()[0] <= tolerance * max(asked, 1.0):
            break
        now = now.drop("before")
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("cell") / F.col("tokens"))).otherwise(0.0)
    return now.select(*[F.col(m).alias(f"_m_{m}") for m in MARGINS], (p / budget).alias("weight"), p.alias("probability"))


def tempered(sums: np.ndarray, power: float = TEMPER) -> np.ndarray:
    """Shares of a marginal raised to a power and scaled to one."""
    raised = np.where(sums > 0, sums, 0.0) ** power * (sums > 0)
    return raised / max(raised.sum(), 1e-300)


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL))


def cell_probabilities(cells: list[tuple], budget: float = BUDGET, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None) -> list[tuple]:
    """(source, lang, topic, tokens) -> (source, lang, topic, weight factor, probability)."""
    if not cells:
        return []
    names = [sorted({c[i] for c in cells}) for i in range(3)]
    at = [{v: k for k, v in enumerate(n)} for n in names]
    codes = [np.array([at[i][c[i]] for c in cells]) for i in range(3)]
    present = np.array([float(c[3]) for c in cells])
    shares = []
    for i, margin in enumerate(MARGINS):
        own = np.bincount(codes[i], present, len(names[i]))
        given = (targets or {}).get(margin)
        if given is None:
            shares.append(tempered(own, temper))
        else:
            wanted = np.array([max(0.0, given.get(v, 0.0)) for v in names[i]]) * (own > 0)
            shares.append(wanted / max(wanted.sum(), 1e-300))
    fitted = rake_cells(present, codes, shares, budget * present.sum())
    p = np.minimum(1.0, np.divide(fitted, present, out=np.zeros_like(present), where=present > 0))
    return [(c[0], c[1], c[2], float(x / budget), float(x)) for c, x in zip(cells, p, strict=True)]


def residuals(drawn: DataFrame, budget: float = BUDGET, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(margin, category, asked, expected, gap) of a ``mixture``: tokens that each category's target asks for and what the probabilities give."""
    spark = drawn.sparkSession
    cells = drawn.groupBy(*[_named(m).alias(m) for m in MARGINS]).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"))
    cells = write_shared(cells, "mixing-expected")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out = None
    for m in MARGINS:
        own = cells.groupBy(F.col(m).alias("category")).agg(F.sum("tokens").cast("double").alias("own"), F.sum("expected").alias("expected"))
        given = (targets or {}).get(m)
        if given is None:
            wanted = own.withColumn("wanted", F.when(F.col("own") > 0, F.pow("own", F.lit(float(temper)))).otherwise(0.0))
        else:
            stated = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in given.items()], "category string, stated double")
            wanted = own.join(stated, "category", "full").select("category", F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("stated", F.lit(0.0)).alias("wanted"))
        scale = max(float(wanted.agg(F.sum("wanted")).first()[0] or 0), 1e-300)
        asked = F.col("wanted") / scale * (budget * total)
        part = wanted.select(F.lit(m).alias("margin"), "category", asked.alias("asked"), "expected", (F.col("expected") - asked).alias("gap"))
        out = part if out is None else out.unionAll(part)
    return out


def mixture(docs: DataFrame, budget: float = BUDGET, temper: float = TEMPER, targets: dict[str, dict[str, float]] | None = None, seed: int = 17, max_categories: int | None = None, topics: str | None = None, strict: bool = False) -> DataFrame:
    """Every document with n_tokens, topic, weight, probability and selected.

    One aggregation makes the cell table. It comes to the driver if it has ``DRIVER_CELLS`` rows
    at most and goes back as a small join side; a larger one stays in Spark. No category is pooled unless asked for.
    ``topics`` names a column to take instead of the form of the text; ``strict`` raises if a category's
    target is missed by more than a thousandth of the budget.
    """
    spark = docs.sparkSession
    given = F.col(topics).cast("string") if topics else None
    seen = docs.withColumn("_m_given", given) if topics else docs
    seen = seen.drop("n_tokens", "topic", "weight", "probability", "selected").withColumn("n_tokens", n_tokens())
    seen = seen.withColumn("topic", F.col("_m_given")).drop("_m_given") if topics else seen.withColumn("topic", topic())
    # written once: a few small questions are asked of it, the documents are read once for it
    sums = write_shared(seen.groupBy(*[_named(m).alias(m) for m in MARGINS]).agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
    kept = {}
    for m in MARGINS[:2] if max_categories is not None else ():
        top = sums.groupBy(m).agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), m).limit(max_categories + 1).collect()
        if len(top) > max_categories:
            kept[m] = [r[0] for r in top[:max_categories]] + list((targets or {}).get(m) or ())
    pooled = lambda m: _named(m) if kept.get(m) is None else F.when(_named(m).isin(kept[m]), _named(m)).otherwise(OTHER)
    cells = sums.groupBy(*[pooled(m).alias(m) for m in MARGINS]).agg(F.sum("tokens").alias("tokens")) if kept else sums
    few = cells.limit(DRIVER_CELLS + 1).collect()
    if len(few) <= DRIVER_CELLS:
        fitted = cell_probabilities(sorted(tuple(r) for r in few), budget, temper, targets)
        table = spark.createDataFrame(fitted, "_m_source string, _m_lang string, _m_topic string, weight double, probability double")
    else:
        table = rake_table(cells, budget, temper, targets)
    on = [pooled(m) == F.col(f"_m_{m}") for m in MARGINS]
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    # a cell table that came through the driver is small by DRIVER_CELLS; a larger one meets the documents in a shuffle
    drawn = (
        seen.join(F.broadcast(table) if len(few) <= DRIVER_CELLS else table, on[0] & on[1] & on[2], "left")
        .withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(0.0))})
        .withColumn("selected", draw < F.col("probability"))
        .drop("_m_source", "_m_lang", "_m_topic")
    )
    if strict:
        worst = residuals(drawn, budget, temper, targets).orderBy(F.desc(F.abs("gap"))).first()
        asked = float(drawn.agg(F.sum("n_tokens")).first()[0] or 0) * budget
        if worst is not None and abs(worst["gap"]) > 1e-3 * max(asked, 1.0):
            raise ValueError(f"the targets cannot be met: {worst['margin']} {worst['category']} asks for {worst['asked']:.0f} tokens and gets {worst['expected']:.0f}")
    return drawn
