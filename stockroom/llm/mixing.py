"""Mixing sources to target weights by hierarchical budgeting, native.

Documents are leaves of a tree domain - language - source. The token budget
flows from the root down: at each node it is dealt to the children by weight;
a child that cannot use its share (its capacity is its tokens times the
epochs allowed) leaves the rest to its siblings, and only what all of them
cannot use goes back to the ancestor's other children. Integer arithmetic
throughout. Each leaf then takes whole epochs plus the prefix of one more
epoch, in an order seeded per epoch. The prefix is found from sums over
ranges of the order, so that no leaf is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockroom.llm.common import materialize, words

LEVELS = ("domain", "lang", "source")
# Sources are dealt to this many domains by the checksum of their name.
DOMAINS = 4
# Target weights (integers): per (level, node); all others weigh 1.
WEIGHTS = {("lang", "en"): 3}
# Share of all tokens to select, in percent, and epochs a leaf may be read.
BUDGET_PERCENT = 90
MAX_EPOCHS = 2
SEED = 6
# Rounds per tree level in which the tokens that leaves left over are given away.
PASSES = 2
# The order of a leaf is cut into 2 ** BITS ranges of equal width.
BITS = 12
_ORDER_BITS = 60


def domain_of(source: Column, domains: int = DOMAINS) -> Column:
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % domains).cast("string"))


def order_key(epoch: Column, identity: Column, seed: int = SEED) -> Column:
    """Seeded place of a document in an epoch, 0 to 2**60 - 1."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), identity)), 1, 15), 16, 10).cast("long")


def leaf_table(stats: DataFrame) -> DataFrame:
    return stats.groupBy(*LEVELS).agg(F.sum("tokens").cast("decimal(38,0)").alias("tokens"))


def _weight(level: str, weights: dict[tuple[str, str], int]) -> Column:
    w = F.lit(1)
    for (lv, node), value in sorted(weights.items()):
        if lv == level:
            w = F.when(F.col(level) == node, F.lit(value)).otherwise(w)
    return w.cast("decimal(38,0)")


def deal(children: DataFrame, parent: list[str], level: str, weights: dict[tuple[str, str], int]) -> DataFrame:
    """``children`` (one row per node with capacity and its parent's budget)
    with their own budget: water filling by weight. In the order of capacity
    per weight, a child is full if the level reached with it full costs no
    more than the budget; the others share the rest by weight."""
    w = children.withColumn("w", _weight(level, weights))
    # capacity / weight decides the order; exact ties and equal nodes by name.
    order = [(F.col("capacity") / F.col("w")).asc(), F.col(level).asc_nulls_first()]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    big = "decimal(38,0)"
    w = w.withColumns({"used": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(big),
                       "open": F.sum("w").over(onward).cast(big)})
    full = (F.col("capacity") * F.col("open") + F.col("used") * F.col("w")).cast(big) <= (F.col("budget") * F.col("w")).cast(big)
    w = w.withColumn("full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(whole), F.lit(0)).cast(big)
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole).cast(big)
    w = w.withColumns({"rest": rest.cast(big), "open_w": open_w})
    share = F.floor((F.col("rest") * F.col("w")).cast(big) / F.col("open_w")).cast(big)
    return w.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(
        F.least(share, F.col("capacity"))).cast(big)).drop("w", "used", "open", "full", "rest", "open_w")


def budgets(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
            weights: dict[tuple[str, str], int] = WEIGHTS) -> DataFrame:
    """Leaves with capacity and budget, dealt level by level from the root."""
    big = "decimal(38,0)"
    caps = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast(big))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budget = int(total) * budget_percent // 100
    parent: list[str] = []
    above = None
    for level in LEVELS:
        keys = [*parent, level]
        nodes = caps.groupBy(*keys).agg(F.sum("capacity").cast(big).alias("capacity"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast(big))
        else:
            up = above.select(*[F.col(k).alias(f"up_{k}") for k in parent], "budget")
            match = None
            for k in parent:
                same = F.col(k).eqNullSafe(F.col(f"up_{k}"))
                match = same if match is None else match & same
            nodes = nodes.join(up, match).select(*keys, "capacity", "budget")
        above = materialize(deal(nodes, parent, level, weights), f"mix-{level}")
        parent = keys
    return above


def document_stats(docs: DataFrame) -> DataFrame:
    """Adds domain, tokens (words, one at least) and identity. A document is
    identified by its id and the digest of its text, so repeated ids with
    different texts are different documents."""
    return docs.withColumns({
        "domain": domain_of(F.col("source")),
        "tokens": F.greatest(F.size(words(F.col("text"))), F.lit(1)).cast("long"),
        "identity": F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"),
                             F.md5(F.coalesce(F.col("text"), F.lit(""))))})


def _same_leaf(a: str, b: str) -> Column:
    match = F.lit(True)
    for k in LEVELS:
        match = match & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return match


def selection_rule(stats: DataFrame, leaf_budgets: DataFrame, leaves: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per leaf: epochs taken whole (``whole``), the last place in the next
    epoch's order that is still taken (``upto``, -1 for none), the tokens
    ``spent`` and ``unspent``, and the tokens that the next document needs
    (``needs``, null if the leaf is used up). Documents of equal place
    (repeated rows) are taken together or not at all.

    Range sums come first; only the range in which the budget ends is looked
    at document by document."""
    over = F.col("b.over") if "over" in leaf_budgets.columns else F.lit(0).cast("decimal(38,0)")
    leaf = leaf_budgets.alias("b").join(leaves.alias("l"), _same_leaf("b", "l")).select(
        *[F.col(f"b.{k}") for k in LEVELS], F.col("b.budget"), F.col("l.tokens"), over.alias("over"))
    leaf = materialize(leaf.withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
                       .withColumn("rest", (F.col("budget") - F.col("whole") * F.col("tokens")).cast("long")), "mix-leaf")
    placed = (stats.alias("s").join(leaf.alias("f"), _same_leaf("s", "f"))
              .select(*[F.col(f"s.{k}") for k in LEVELS], "s.tokens", "f.whole", "f.rest",
                      order_key(F.col("f.whole"), F.col("s.identity")).alias("place")))
    placed = materialize(placed.withColumn("range", F.shiftright("place", _ORDER_BITS - BITS)), "mix-placed")
    sums = placed.groupBy(*LEVELS, "whole", "rest", "range").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*LEVELS).orderBy("range")
    sums = sums.withColumn("upto", F.sum("tokens").over(run))
    below = sums.groupBy(*LEVELS).agg(
        F.max("whole").alias("whole"), F.max("rest").alias("rest"),
        F.max(F.when(F.col("upto") <= F.col("rest"), F.col("range"))).alias("last_range"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("spent"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.col("range"))).alias("edge"))
    below = materialize(below, "mix-ranges")
    edge = (placed.alias("p").join(below.alias("e"), _same_leaf("p", "e") & (F.col("p.range") == F.col("e.edge")))
            .select(*[F.col(f"p.{k}") for k in LEVELS], "p.place", "p.tokens", "p.rest", "e.spent"))
    along = Window.partitionBy(*LEVELS).orderBy("place")
    ends = (edge.withColumn("upto", F.col("spent") + F.sum("tokens").over(along)).groupBy(*LEVELS)
            .agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("place"))).alias("place"),
                 F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("spent"),
                 F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).alias("beyond")))
    width = 1 << (_ORDER_BITS - BITS)
    j = (below.alias("e").join(ends.alias("x"), _same_leaf("e", "x"), "left").join(leaf.alias("f"), _same_leaf("e", "f"))
         .select(*[F.col(f"e.{k}") for k in LEVELS], "e.whole",
                 F.coalesce("x.place", (F.col("e.last_range") + 1) * width - 1, F.lit(-1)).alias("upto"),
                 F.coalesce("x.spent", "e.spent").alias("part"), "x.beyond", "e.rest", "f.tokens", "f.over"))
    big = "decimal(38,0)"
    return materialize(j.select(
        *LEVELS, "tokens", "whole", "upto", (F.col("whole") * F.col("tokens") + F.col("part")).cast(big).alias("spent"),
        (F.col("rest") - F.col("part") + F.col("over")).cast(big).alias("unspent"),
        F.when(F.col("whole") < max_epochs, F.col("beyond") - F.col("part")).cast(big).alias("needs")), "mix-rule")


def pool_unspent(rule: DataFrame, parent: list[str], max_epochs: int) -> DataFrame:
    """Leaves that get the tokens left over by all leaves below the same
    ``parent``: per parent the leaf whose next document needs least, if the
    pool pays for it, with its new budget and what that leaves ``over`` beyond
    its capacity. One row per parent at most."""
    big = "decimal(38,0)"
    w = Window.partitionBy(*parent)
    pooled = rule.withColumn("pool", F.sum("unspent").over(w)).where(F.col("needs") <= F.col("pool"))
    first = F.row_number().over(w.orderBy("needs", *[F.col(k).asc_nulls_first() for k in LEVELS]))
    whole = (F.col("spent") + F.col("pool")).cast(big)
    budget = F.least(whole, (F.col("tokens") * max_epochs).cast(big))
    return pooled.withColumn("first", first).where("first = 1").select(
        *LEVELS, budget.alias("budget"), (whole - budget).cast(big).alias("over"))


def spend_rest(stats: DataFrame, rule: DataFrame, leaves: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A leaf ends at the first document that does not fit. What it leaves
    over goes to its siblings first, then to the other leaves of the domain,
    then to all: PASSES times per level the pool goes to the leaf whose next
    document needs least. Only those leaves are selected anew."""
    for depth in range(len(LEVELS) - 1, -1, -1):
        parent = list(LEVELS[:depth])
        for _ in range(PASSES):
            given = materialize(pool_unspent(rule, parent, max_epochs), "mix-pool")
            if given.isEmpty():
                break
            new = selection_rule(stats, given, leaves, max_epochs)
            kept = rule.alias("r").join(new.select(*LEVELS).alias("n"), _same_leaf("r", "n"), "left_anti")
            if parent:
                same = F.lit(True)
                for k in parent:
                    same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}"))
                gave = given.select(*parent, F.lit(True).alias("gave")).alias("p")
                kept = kept.join(gave, same, "left").select("r.*", "p.gave")
            else:
                kept = kept.withColumn("gave", F.lit(True))
            # Where the pool was given away, the other leaves have nothing left over.
            left = F.when(F.col("gave"), F.lit(0)).otherwise(F.col("unspent")).cast("decimal(38,0)").alias("unspent")
            rule = materialize(new.unionByName(kept.select(*[left if c == "unspent" else F.col(c) for c in rule.columns])), "mix-spent")
    return rule


def mixing_rule(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
                weights: dict[tuple[str, str], int] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(document statistics without text, selection rule per leaf)."""
    stats = materialize(document_stats(docs.select("doc_id", "lang", "source", "text")).select(
        "doc_id", *LEVELS, "tokens", "identity"), "mix-stats")
    leaves = materialize(leaf_table(stats), "mix-leaves")
    rule = selection_rule(stats, budgets(leaves, budget_percent, max_epochs, weights), leaves, max_epochs)
    return stats, spend_rest(stats, rule, leaves, max_epochs)


def _copies(rows: DataFrame, rule: DataFrame) -> DataFrame:
    """Rows (with leaf columns and identity) joined to their leaf's rule, with ``copies``."""
    j = rows.alias("s").join(rule.alias("r"), _same_leaf("s", "r"))
    taken = order_key(F.col("r.whole"), F.col("s.identity")) <= F.col("r.upto")
    return j.select("s.*", (F.col("r.whole") + taken.cast("int")).alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, tokens, copies) per selected document:
    how many epochs it appears in. Null texts count one token; null languages
    and sources are nodes of their own; extra columns are ignored; empty
    input gives no rows."""
    stats, rule = mixing_rule(docs, **options)
    return _copies(stats, rule).where("copies > 0").select("doc_id", *LEVELS, "tokens", "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs`` with their own columns, once per epoch.
    No text is shuffled unless the rule outgrows a broadcast."""
    _, rule = mixing_rule(docs, **options)
    whole = document_stats(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                                       "doc_id", "lang", "source", "text"))
    return (_copies(whole.select("__row", *LEVELS, "identity"), rule).where("copies > 0")
            .select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*"))
