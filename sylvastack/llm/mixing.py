"""Mixing sources to target weights: tempered token shares, a bisected exponent, and budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize

#: Words as in every corpus query: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Bisection levels that one job settles.
LEVELS = 5
#: Weights are whole millionths, so budgets are whole numbers on every engine.
UNIT = 1_000_000


def token_count(text: str = "text") -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


@dataclass
class Tempering:
    exponent: float
    entropy: float
    repeats: float
    z: float


def _evaluate(shares: DataFrame, exponents: list[float], budget_share: float | None, top: float) -> dict[float, Tempering]:
    """Entropy and the largest repetition of a source under each exponent: one partial-and-final aggregate over the sources.

    Without a budget the largest source, whose log share is ``top``, is passed once and sets the repetition of the others.
    """
    a = F.col("a")
    w = F.exp(a * F.col("lp"))
    grid = shares.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    rows = grid.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.col("lp")).alias("s"), F.max(F.exp((a - 1) * F.col("lp"))).alias("r")).collect()
    passes = lambda x: x.r * exp((1 - x.a) * top) if budget_share is None else budget_share * x.r / x.z
    return {x.a: Tempering(x.a, log(x.z) - x.a * x.s / x.z, passes(x), x.z) for x in rows}


def find_exponent(shares: DataFrame, entropy_gain: float | None, max_repeats: float | None, budget_share: float | None, steps: int = 40) -> Tempering:
    """The exponent in [0, 1] that meets the targets; ``shares`` has lp, the log of each source's positive token share.

    entropy_gain: the share of the way from the plain entropy to that of equal weights that the mixture must go.
    max_repeats: where a source would be passed more often than that, the exponent rises to meet the limit instead;
    at exponent 1 every source is passed ``budget_share`` times, and no exponent can do with less.
    budget_share None: the budget covers every source at least once, so it follows the weights.
    """
    top = shares.agg(F.max("lp")).first()[0]

    def at(exponents: list[float]) -> dict[float, Tempering]:
        return _evaluate(shares, exponents, budget_share, top)

    ends = at([0.0, 1.0])
    target = None if entropy_gain is None else ends[1.0].entropy + entropy_gain * (ends[0.0].entropy - ends[1.0].entropy)

    def met(t: Tempering, goal: str) -> bool:
        return t.entropy <= target if goal == "entropy" else t.repeats <= max_repeats

    def bisect(lo: float, hi: float, goal: str) -> float:
        """The least exponent that meets a goal which holds from some point up to 1."""
        for _ in range(0, steps, LEVELS):
            parts = 1 << LEVELS
            inner = [lo + (hi - lo) * i / parts for i in range(1, parts)]
            seen = at(inner)
            ok = [met(seen[x], goal) for x in inner] + [True]
            k = ok.index(True)
            lo, hi = ([lo] + inner)[k], (inner + [hi])[k]
        return hi

    a = 1.0 if target is None else 0.0 if met(ends[0.0], "entropy") else bisect(0.0, 1.0, "entropy")
    chosen = at([a])[a]
    if max_repeats is not None and chosen.repeats > max_repeats:
        a = 1.0 if ends[1.0].repeats >= max_repeats else bisect(a, 1.0, "repeats")
        chosen = at([a])[a]
    return chosen


def _draw(*parts: Column) -> Column:
    """A number of 52 bits from an MD5 digest: the same draw on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def source_weights(docs: DataFrame, source_col: str = "source", tokens_col: str = "n_tokens", entropy_gain: float | None = 0.5, max_repeats: float | None = 4.0, budget: int | None | str = None) -> DataFrame:
    """(source, tokens, weight, budget): one row for each source with tokens; weight in millionths, budget in tokens.

    budget: tokens of the mixture; None: as many as the input has; "cover": enough to pass every source at least once.
    A null source is a source of its own. Sources without tokens have no share and no row. Empty table: empty result.
    """
    totals = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).cast("long").alias("tokens")).where("tokens > 0"))
    whole = totals.agg(F.sum("tokens")).first()[0]
    if not whole:
        return totals.withColumn("weight", F.lit(0).cast("long")).withColumn("budget", F.lit(0).cast("long"))
    shares = totals.withColumn("lp", F.log(F.col("tokens") / F.lit(float(whole))))
    given = whole if budget is None else budget
    found = find_exponent(shares, entropy_gain, max_repeats, None if budget == "cover" else given / whole)
    weight = F.greatest(F.lit(1), F.round(F.exp(F.lit(found.exponent) * F.col("lp")) / F.lit(found.z) * UNIT).cast("long"))
    weighted = shares.withColumn("weight", weight)
    if budget == "cover":
        given = weighted.agg(F.max(F.expr(f"(tokens * {UNIT} + weight - 1) div weight"))).first()[0]
    return weighted.select("source", "tokens", "weight", F.expr(f"cast(weight * cast({given} as decimal(38,0)) div {UNIT} as bigint)").alias("budget"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens_col: str = "n_tokens", entropy_gain: float | None = 0.5, max_repeats: float | None = 4.0, budget: int | None | str = None, block_tokens: int = 1 << 18, seed: int = 17, buckets: int = 1024) -> DataFrame:
    """Rows of the mixture: struct ``row`` (all columns of ``docs``), repeat, block, position, source_weight.

    Each source is passed in a fresh permutation until its budget is met: full passes, then the head of one more. Its
    stream is cut so that every block of ``block_tokens`` takes each source at its weight; within a block the rows are
    permuted, position counts from 0. A row that starts before the budget's end is in. Equal rows are rows of their
    own, their order in a permutation is open. A row without an id draws by a hash of its columns. Null tokens count as 0.

    No source is gathered: running sums go over ``buckets`` slices of each permutation, and rows are sorted inside a
    slice only, so a source that holds most rows spreads over ``buckets`` tasks and more for each pass.
    """
    spark_weights = source_weights(docs.withColumn(tokens_col, F.coalesce(F.col(tokens_col), F.lit(0))), source_col, tokens_col, entropy_gain, max_repeats, budget)
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("n"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashed))).alias("id"))
    # The weights hold one narrow row a source; Spark broadcasts them only under its size limit and else splits the hot source.
    w = spark_weights.withColumnRenamed("source", "ws")
    passes = rows.join(w, F.col("source").eqNullSafe(F.col("ws"))).where("budget > 0")
    passes = passes.withColumn("repeat", F.explode(F.expr("sequence(0, cast((budget - 1) div tokens as int))")))
    drawn = passes.withColumn("draw", _draw(F.lit(str(seed)), F.col("repeat").cast("string"), F.col("id")))
    drawn = drawn.withColumn("slice", F.expr(f"cast(draw div {(1 << 52) // buckets} as int)"))
    drawn = drawn.withColumn("ws", F.coalesce(F.concat(F.lit("="), "ws"), F.lit("")))  # a null source must meet itself in joins
    key = ["ws", "repeat", "slice"]
    sums = drawn.groupBy(*key).agg(F.sum("n").alias("slice_n"))
    before = Window.partitionBy("ws", "repeat").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, F.coalesce(F.sum("slice_n").over(before), F.lit(0)).alias("slice_at"))
    inside = Window.partitionBy(*key).orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, key)
    placed = placed.withColumn("at", F.col("repeat") * F.col("tokens") + F.col("slice_at") + F.col("inside")).where("at < budget")
    blocked = placed.withColumn("block", F.expr(f"at div greatest(1, weight * {block_tokens} div {UNIT})"))
    shuffled = _draw(F.lit(str(seed)), F.lit("block"), F.col("block").cast("string"), F.col("repeat").cast("string"), F.col("id"))
    order = Window.partitionBy("block").orderBy("within", "id", "repeat")
    blocked = blocked.withColumn("within", shuffled)
    return blocked.select("row", F.col("repeat").cast("int").alias("repeat"), "block", (F.row_number().over(order) - 1).cast("long").alias("position"), F.col("weight").alias("source_weight"))


def oracle(entropy_gain: float = 0.5, max_repeats: float = 4.0, block_tokens: int = 1 << 18, seed: int = 17, steps: int = 40) -> str:
    """The rows of op1_mixing in DuckDB SQL: one exponent a recursion step, plain running sums."""
    entropy = "ln(list_sum(list_transform(lp, lambda x: exp({a} * x)))) - {a} * list_sum(list_transform(lp, lambda x: exp({a} * x) * x)) / list_sum(list_transform(lp, lambda x: exp({a} * x)))"
    repeats = "list_max(list_transform(lp, lambda x: exp(({a} - 1) * x))) / list_sum(list_transform(lp, lambda x: exp({a} * x)))"
    draw = "cast('0x' || substr(md5({x}), 1, 13) as bigint)"
    return rf"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint n from documents),
tot as (select source, sum(n)::bigint tokens from d group by 1 having sum(n) > 0),
whole as (select sum(tokens)::bigint w, list(ln(tokens / (select sum(tokens) from tot)::double) order by tokens) lp from tot),
goal as (select *, {entropy.format(a="1.0")} + {entropy_gain} * (({entropy.format(a="0.0")}) - ({entropy.format(a="1.0")})) as target from whole),
b(step, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, case when {entropy.format(a="((lo+hi)/2)")} <= target then lo else (lo+hi)/2 end,
                   case when {entropy.format(a="((lo+hi)/2)")} <= target then (lo+hi)/2 else hi end
  from b, goal where step < {steps}),
e as (select case when {entropy.format(a="0.0")} <= target then 0.0 else hi end a from b, goal where step = {steps}),
c(step, lo, hi) as (
  select 0, a, 1.0::double from e
  union all
  select step + 1, case when {repeats.format(a="((lo+hi)/2)")} <= {max_repeats} then lo else (lo+hi)/2 end,
                   case when {repeats.format(a="((lo+hi)/2)")} <= {max_repeats} then (lo+hi)/2 else hi end
  from c, goal where step < {steps}),
x as (select case when {repeats.format(a="e.a")} <= {max_repeats} then e.a else c.hi end a from e, c, goal where c.step = {steps}),
wt as (
  select source, tokens, greatest(1, round(exp(a * ln(tokens / w::double)) / list_sum(list_transform(lp, lambda y: exp(a * y))) * {UNIT})::bigint) weight, w
  from tot, x, goal),
bud as (select source, tokens, weight, (weight::hugeint * w::hugeint) / {UNIT} as q from wt),
bd as (select source, tokens, weight, floor(q)::bigint budget from bud),
p as (
  select d.doc_id, d.source, d.n, tokens, weight, budget, unnest(generate_series(0, floor((budget - 1) / tokens)::bigint)) as rep
  from d join bd on d.source is not distinct from bd.source where budget > 0),
o as (
  select *, rep * tokens + coalesce(sum(n) over (partition by source, rep order by {draw.format(x=f"'{seed}:' || rep || ':' || doc_id")}, doc_id rows between unbounded preceding and 1 preceding), 0) as place from p),
k as (select *, floor(place / greatest(1, floor(weight * {block_tokens} / {UNIT})))::bigint as block from o where place < budget)
select doc_id, source, rep::int as "repeat", block, (row_number() over (partition by block order by {draw.format(x=f"'{seed}:block:' || block || ':' || rep || ':' || doc_id")}, doc_id::varchar, rep) - 1)::bigint as position, n as n_tokens, weight::bigint as source_weight
from k"""
