"""Mixing sources to target weights (operator 8).

The tree has three levels (domain, language, source).  A token budget runs down
from the root: siblings share their parent's budget by weight, none gets more
than its subtree can give (``max_epochs`` times its tokens), and what a short
child leaves goes to its siblings by weight.  As a parent is never given more
than its subtree holds, shortages are met by siblings first and reach the next
level only when a whole subtree is short.  Fractions of a token are not dealt.

A leaf's budget buys whole epochs and then the prefix of one more, in the order
of a hash of seed, epoch and row.  The prefix's end is found in two steps: token
sums per bucket of the hash, then the rows of the one bucket that it falls into;
rows themselves are never sorted per leaf.

Defined results: null or empty texts have no tokens and are never drawn; null
language or source is the leaf ``(none)``; equal rows have equal hashes and are
taken together or not at all; siblings of weight zero get nothing; an empty
table gives an empty result.  Columns of the input stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import OWN, written

LEVELS = [f"{OWN}domain", f"{OWN}lang", f"{OWN}source"]
#: Leaf plans up to so many rows are broadcast; more are joined by shuffle.
BROADCAST_LEAVES = 50_000
BUCKET_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("bigint")


def share_out(children: DataFrame, parent: list[str], name: str, budget: str = "budget") -> DataFrame:
    """``children`` with ``given``: the parent's budget by ``weight``, none above ``cap``."""
    order = [(F.col("cap") / F.col("weight")).asc(), F.col(name).asc()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    out = children.filter("weight > 0").withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(onward))
    out = out.withColumn("full", (F.col(budget) - F.col("spent")) * F.col("weight") >= F.col("cap") * F.col("open"))
    out = out.withColumn("spent", F.min(F.when(~F.col("full"), F.col("spent"))).over(whole)).withColumn("open", F.max(F.when(~F.col("full"), F.col("open"))).over(whole))
    part = F.expr(f"({budget} - spent) * weight div open")
    return out.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("spent", "open", "full")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, int], max_epochs: int) -> DataFrame:
    """Leaves (``tokens`` each) with ``given`` tokens; weights by path, 1 where none is named."""
    d, g, s = LEVELS
    known = F.create_map(*[F.lit(x) for pair in (weights or {"": 1}).items() for x in pair])
    weight = lambda *path: F.coalesce(F.try_element_at(known, F.concat_ws("/", *path)), F.lit(1)).cast("bigint")
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaves.groupBy(d, g).agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy(d).agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(budget.cast("bigint").alias("budget"), F.lit(0).alias("root"))
    domains = domains.withColumn("root", F.lit(0)).join(total, "root").withColumn("weight", weight(d))
    given = share_out(domains, ["root"], d).select(d, F.col("given").alias("budget"))
    given = share_out(langs.join(given, d).withColumn("weight", weight(d, g)), [d], g).select(d, g, F.col("given").alias("budget"))
    return share_out(leaves.join(given, [d, g]).withColumn("weight", weight(d, g, s)), [d, g], s).select(*LEVELS, "tokens", "n", "given")


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, int], budget: Column | None = None, max_epochs: int = 4, seed: int = 7,
    doc_id: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """``docs`` once per draw, with ``domain``, ``tokens`` and ``epoch``.

    ``budget`` is a number of tokens, or an expression over ``tokens``, the sum of the table.
    """
    own = docs
    for name, value in zip(LEVELS, (domain, F.col(lang), F.col(source)), strict=True):
        own = own.withColumn(name, F.coalesce(value.cast("string"), F.lit("(none)")))
    base, tokens, key, leaf = f"{OWN}base", f"{OWN}tokens", f"{OWN}key", f"{OWN}leaf"
    text_part = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    own = own.withColumn(base, F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_part).cast("binary")))
    slim = written(own.select(*LEVELS, base, n_words(F.col(text_col)).alias("tokens")), "mix")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    plan = budgets(leaves, F.expr("tokens div 2") if budget is None else budget, weights, max_epochs)
    plan = plan.withColumn("epochs", F.expr("if(tokens > 0, given div tokens, 0)")).withColumn("rest", F.col("given") - F.col("epochs") * F.col("tokens"))
    plan = written(plan, "mix-plan")
    size = plan.agg(F.count("*").alias("leaves"), F.coalesce(F.max("n"), F.lit(0)).alias("rows")).first()
    small = (lambda df: F.broadcast(df)) if size["leaves"] <= BROADCAST_LEAVES else (lambda df: df)
    digits = max(2, math.ceil(math.log(max(1, size["rows"] / BUCKET_ROWS), 16)))

    order = lambda epochs: F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.col(base)).cast("binary"))
    bucket = F.substring("key", 1, digits).alias("bucket")
    part = slim.filter("tokens > 0").join(small(plan.filter("rest > 0").select(*LEVELS, "epochs", "rest")), LEVELS).withColumn("key", order(F.col("epochs")))
    sums = part.groupBy(*LEVELS, bucket).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("tokens").over(upto)).filter("upto > rest and upto - tokens <= rest")
    last = written(sums.select(*LEVELS, "bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left")), "mix-cut")
    inner = part.withColumn("bucket", bucket).join(small(last), [*LEVELS, "bucket"])
    inner = inner.groupBy(*LEVELS, "bucket", "key").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    inner = inner.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("key")))
    cut = inner.filter("upto <= left").groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    cut = last.join(cut, LEVELS, "left").select(*LEVELS, F.coalesce("cut", "bucket").alias("cut"))
    plan = written(plan.join(cut, LEVELS, "left").select(*LEVELS, F.struct("epochs", "cut").alias(leaf)), "mix-leaves")

    own = own.withColumn(tokens, n_words(F.col(text_col))).filter(F.col(tokens) > 0).join(small(plan), LEVELS)
    own = own.withColumn(key, order(F.col(f"{leaf}.epochs")))
    draws = F.col(f"{leaf}.epochs") + F.when(F.col(key) <= F.col(f"{leaf}.cut"), 1).otherwise(0)
    own = own.withColumn(leaf, draws.cast("int")).filter(F.col(leaf) > 0)
    own = own.withColumn(leaf, F.explode(F.sequence(F.lit(0), F.col(leaf) - 1)))
    return own.withColumn("domain", F.col(LEVELS[0])).withColumn("tokens", F.col(tokens)).withColumn("epoch", F.col(leaf)).drop(*LEVELS, base, tokens, key, leaf)
