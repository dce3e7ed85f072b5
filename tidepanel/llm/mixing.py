"""Mixing sources to target weights by hierarchical budgeting, in DataFrame and SQL functions only.

The documents form a tree: domain, language within it, source within that. A token budget is propagated from the root by integer weights.
A node never gets more than its subtree can give (its tokens times `epochs`); what it cannot use goes to its siblings by their weights,
and only when all of them are full to the relatives of its parent. In closed form: of siblings in order of capacity per weight, those are
full whose capacity does not exceed their share of what the ones before them leave; the rest divide the remainder by weight, rounded down.

A leaf's allocation is read in seeded epochs: whole passes over it, then the prefix of one more, ordered by the digest of seed, epoch and id,
whose running total of tokens stays within the rest. The prefix is found in two steps, so no leaf is sorted in one task: digests fall into
equal bins of about `bin_rows` rows, whose totals are accumulated, and only the rows of the bin in which the rest runs out are ordered.
Every row is then compared with the cut of its leaf, which needs no shuffle.

Null domains, languages and sources are leaves of their own, named by the empty string. Null and empty texts have no tokens and are never
selected, nor is anything from a leaf without weight. Rows with equal ids share their place, so they are in or out together. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import written

LEVELS = ("domain", "lang", "source")
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def place(seed: int, epoch: Column, doc_id: Column) -> Column:
    """32 hex digits that order a leaf's rows in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def divide(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """`given` of each node: its share of `budget`, which its siblings (equal `parents`) have in common; weight and capacity are its own.

    budget must not exceed the siblings' capacity together.
    """
    order = [F.col("capacity") / F.col("weight"), *LEVELS[: len(parents) + 1]]
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here_on = siblings.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = siblings.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = lambda c: F.col(c).cast(WIDE)
    step = nodes.withColumn("left", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))).withColumn("weights", F.sum("weight").over(here_on))
    step = step.withColumn("is_full", wide("capacity") * wide("weights") <= wide("weight") * wide("left"))
    rest = lambda c: F.coalesce(F.sum(F.when(F.col("is_full"), F.lit(0)).otherwise(F.col(c))).over(full), F.lit(0))
    step = step.withColumn("open", F.col("budget") - F.sum(F.when(F.col("is_full"), F.col("capacity")).otherwise(0)).over(full)).withColumn("open_weight", rest("weight"))
    share = F.expr(f"(cast(weight as {WIDE}) * cast(open as {WIDE})) div open_weight")
    return step.withColumn("given", F.when(F.col("is_full"), F.col("capacity")).otherwise(share).cast("long")).drop("left", "weights", "is_full", "open", "open_weight")


def allocate(leaves: DataFrame, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves (domain, lang, source, tokens, n, budget) with `given` tokens each; a name without a weight of its own has the level's `*`."""

    def weight(level: str) -> Column:
        out = F.lit(weights[level].get("*", 1))
        for name, value in weights[level].items():
            if name != "*":
                out = F.when(F.col(level) == name, F.lit(value)).otherwise(out)
        return out.cast("long")

    nodes = {3: leaves.withColumn("capacity", F.col("tokens") * epochs)}
    for name in LEVELS:
        nodes[3] = nodes[3].where(weight(name) > 0)
    for depth in (2, 1):
        nodes[depth] = nodes[depth + 1].groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"), F.min("budget").alias("budget"))
    most = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
    given = divide(nodes[1].withColumn("weight", weight("domain")).withColumn("budget", F.least("budget", most)), [])
    for depth in (2, 3):
        parents = list(LEVELS[: depth - 1])
        above = given.select(*parents, F.col("given").alias("budget"))
        given = divide(nodes[depth].drop("budget").join(above, parents).withColumn("weight", weight(LEVELS[depth - 1])), parents)
    return given.select(*LEVELS, "tokens", "n", "given")


def mix(docs: DataFrame, domain: Column, lang: Column, source: Column, share: int, weights: dict[str, dict[str, int]], epochs: int = 2,
        seed: int = 11, doc_id: str = "doc_id", text: str = "text", bin_rows: int = 1024) -> DataFrame:
    """Every row as `row`, with domain, lang, source, n_tokens, the leaf's `given` tokens and `copies`, how often the row is selected.

    The budget is `share` thousandths of all tokens. A leaf has at most 65,536 bins, however many rows.
    """
    named = {"domain": domain, "lang": lang, "source": source}
    leaf = [F.coalesce(c, F.lit("")).alias(k) for k, c in named.items()]
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *leaf, word_count(docs[text]).alias("n_tokens"), docs[doc_id].alias("id"))
    thin = written(rows.select("id", *LEVELS, "n_tokens").where("n_tokens > 0"), "mix-tokens")
    leaves = thin.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # of the leaves: as many rows as there are sources
    budgeted = leaves.withColumn("all_tokens", all_tokens).withColumn("budget", F.expr(f"(all_tokens * {share}L) div 1000"))
    given = allocate(budgeted, epochs, weights).withColumn("passes", F.expr("given div tokens")).withColumn("rest", F.expr("given % tokens"))
    given = written(given, "mix-leaves")

    placed = thin.join(given.where("rest > 0"), list(LEVELS)).withColumn("place", place(seed, F.col("passes"), F.col("id")))
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    bins = F.least(F.ceil(F.col("n") / bin_rows), F.lit(1 << 16))
    binned = placed.withColumn("bin", F.shiftright(head * bins, 32))
    totals = binned.groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    upto = F.sum("bin_tokens").over(Window.partitionBy(*LEVELS).orderBy("bin"))
    edge = totals.withColumn("upto", upto).where("upto > rest and upto - bin_tokens <= rest").select(*LEVELS, "bin", (F.col("upto") - F.col("bin_tokens")).alias("before"))
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bin").orderBy("place", "id"))
    over = binned.join(edge, [*LEVELS, "bin"]).withColumn("running", running).where("running > rest")
    cuts = over.groupBy(*LEVELS).agg(F.min(F.struct("place", "id")).alias("cut"))
    leaf_plan = written(given.join(cuts, list(LEVELS), "left").select(*LEVELS, "given", "passes", "cut"), "mix-cuts")

    told = rows.join(leaf_plan, list(LEVELS), "left")
    here = F.struct(place(seed, F.col("passes"), F.col("id")).alias("place"), F.col("id").alias("id"))
    more = F.when(F.col("cut").isNotNull() & (here < F.col("cut")), 1).otherwise(0)
    copies = F.when(F.col("given").isNull() | (F.col("n_tokens") == 0), 0).otherwise(F.col("passes") + more)
    return told.select("row", *LEVELS, "n_tokens", F.coalesce("given", F.lit(0)).cast("long").alias("given"), copies.cast("long").alias("copies"))


def mixed(selected: DataFrame) -> DataFrame:
    """The rows themselves, each as often as it was selected."""
    return selected.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
