"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a domain-language-source tree; a leaf holds at most ``max_epochs`` times its tokens. What a
node can't take is offered to its siblings, by weight, before it goes up to the ancestors' siblings. A leaf's
documents are then taken in the order of seeded epochs, up to its budget in tokens: the document whose last
token would pass the budget is the first to stay out, and with it others of the same place in the order.

The tree has few leaves: it is what the weights speak of, and MAX_LEAVES bounds what is broadcast or sent to the driver of
it (a row a leaf, checked, an error beyond); documents are never gathered by leaf. A leaf's order
is a keyed hash of (seed, epoch, doc_id, text); the hash space is cut in cells, tokens are summed by (leaf,
cell), and only the one cell in which the budget ends is ordered document by document, for the hash at which
the prefix ends. The number of cells follows the number of rows, so a leaf with a third of all rows is no hot
group, and documents are chosen where they are read.

Defined results: null or blank lang and source form leaves named "?"; empty texts have 0 tokens and are
taken in their place in the order; a column mix_epoch of the input is replaced; a domain, language or source without a weight has weight 1; with no budget
or no tokens, nothing is taken; a document of a further epoch is one more row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import few_rows, materialise

MAX_LEAVES = 20_000
#: Rows of a leaf in a cell, about.
CELL_ROWS = 256


@dataclass
class Node:
    name: tuple[str, ...]
    weight: float = 1.0
    cap: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0


def allocate(node: Node, budget: float) -> float:
    """Gives ``budget`` to ``node``'s leaves; returns what could not be placed. Siblings fill up before the rest goes up."""
    node.budget = placed = min(budget, node.cap)
    if not node.children:
        return budget - placed
    left, given = placed, {id(c): 0.0 for c in node.children}
    for c in node.children:
        c.budget = 0.0
    open_ = [c for c in node.children if c.cap > 0 and c.weight > 0] or [c for c in node.children if c.cap > 0]
    while left > 1e-9 * max(1.0, placed) and open_:
        total = sum(max(c.weight, 0) for c in open_)
        shares = [(c, left * (c.weight / total if total > 0 else 1 / len(open_))) for c in open_]
        full = [c for c, x in shares if given[id(c)] + x >= c.cap]
        for c, x in [(c, c.cap - given[id(c)]) for c in full] if full else shares:
            given[id(c)] += x
            left -= x
        open_ = [c for c in open_ if given[id(c)] < c.cap * (1 - 1e-12)] if full else []
        if not open_:  # weight 0 takes only what no other sibling can
            open_ = [c for c in node.children if c.cap - given[id(c)] > 1e-9 * max(1.0, c.cap) and left > 1e-9 * max(1.0, placed)]
    for c in node.children:
        allocate(c, given[id(c)])
    return budget - placed


def tree(tokens: dict[tuple[str, ...], float], weights: dict[tuple[str, ...], float], max_epochs: float) -> Node:
    root, seen = Node(()), {}
    seen[()] = root
    for leaf in sorted(tokens):
        for k in range(1, len(leaf) + 1):
            if leaf[:k] not in seen:
                seen[leaf[:k]] = Node(leaf[:k], float(weights.get(leaf[:k], 1.0)))
                seen[leaf[: k - 1]].children.append(seen[leaf[:k]])
        for k in range(len(leaf) + 1):
            seen[leaf[:k]].cap += tokens[leaf] * max_epochs
    return root


def leaves(node: Node) -> list[Node]:
    return [node] if not node.children and node.name else [x for c in node.children for x in leaves(c)]


def n_tokens(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def mix(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], float], total: float = 1.0, max_epochs: int = 4, seed: int = 42) -> DataFrame:
    """``docs``' columns and ``mix_epoch`` (from 0) of the chosen documents.

    ``weights``: by (domain,), (domain, lang) or (domain, lang, source), relative to siblings. ``total``: tokens to
    take, as a multiple of the tokens there are.
    """
    name = lambda c: F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", "?").otherwise(c.cast("string"))
    cols = [c for c in docs.columns if c != "mix_epoch"]
    leaf = ["_d", "_l", "_s"]
    places = [name(domain).alias("_d"), name(docs["lang"]).alias("_l"), name(docs["source"]).alias("_s"), F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("_h")]
    # texts are counted here alone; what follows reads four small columns
    key = materialise(docs.select(*places, n_tokens(docs["text"]).alias("_n")), "counted")
    sums = key.groupBy(*leaf).agg(F.sum("_n").alias("n"), F.count("*").alias("rows")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: domain, lang and source must name a tree, not documents")
    have = {(r["_d"], r["_l"], r["_s"]): float(r["n"]) for r in sums}
    root = tree(have, weights, max_epochs)
    allocate(root, total * sum(have.values()))
    budget = {x.name: x.budget for x in leaves(root)}
    # whole epochs are taken outright; the last one as a prefix
    plan = [(*k, int(b // have[k]) if have[k] else 0, float(b - (b // have[k]) * have[k]) if have[k] else 0.0) for k, b in budget.items()]
    cells = 1 << max(0, (max((r["rows"] for r in sums), default=0) // CELL_ROWS).bit_length())
    spark = docs.sparkSession
    goal = F.broadcast(few_rows(spark, plan, "_d string, _l string, _s string, _whole int, _rest double"))  # one row a leaf, at most MAX_LEAVES
    place = lambda df: df.withColumn("_o", F.xxhash64(F.lit(seed), F.col("_e"), F.col("_h"))).withColumn("_c", F.pmod(F.shiftrightunsigned("_o", 32), F.lit(cells)))
    last = place(key.select(*leaf, "_n", "_h").join(goal, leaf).filter("_rest > 0").withColumn("_e", F.col("_whole")))
    # sums by cell, then by blocks of cells, so that no task gets all cells of a leaf
    block = max(1, int(cells**0.5))
    by_cell = materialise(last.groupBy(*leaf, "_c").agg(F.sum("_n").alias("_cn"), F.first("_rest").alias("_rest")).withColumn("_b", F.floor(F.col("_c") / block)), "cells")
    by_block = by_cell.groupBy(*leaf, "_b").agg(F.sum("_cn").alias("_bn"))
    to_here = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    before_block = by_block.withColumn("_bb", F.coalesce(F.sum("_bn").over(to_here(*leaf).orderBy("_b")), F.lit(0))).select(*leaf, "_b", "_bb")
    before = by_cell.join(before_block, [*leaf, "_b"]).withColumn("_before", F.col("_bb") + F.coalesce(F.sum("_cn").over(to_here(*leaf, "_b").orderBy("_c")), F.lit(0)))
    # where a leaf's budget ends: a cell a leaf, then a hash a leaf; at most MAX_LEAVES rows each
    edges = before.filter("_before <= _rest and _before + _cn > _rest").select(*leaf, F.col("_c").alias("_edge"), "_before").collect()
    edge = few_rows(spark, edges, "_d string, _l string, _s string, _edge bigint, _before bigint")
    there = last.join(F.broadcast(edge), leaf).filter("_c = _edge").groupBy(*leaf, "_o", "_before", "_rest").agg(F.sum("_n").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*leaf).orderBy("_o").rowsBetween(W.unboundedPreceding, 0))
    cuts = {tuple(r)[:3]: r["_cut"] for r in there.withColumn("_upto", upto).filter("_upto <= _rest").groupBy(*leaf).agg(F.max("_o").alias("_cut")).collect()}
    ends = {tuple(r)[:3]: r["_edge"] for r in edges}
    full = [(*p, ends.get(p[:3]), cuts.get(p[:3])) for p in plan]
    final = F.broadcast(few_rows(spark, full, "_d string, _l string, _s string, _whole int, _rest double, _edge bigint, _cut bigint"))
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("_row"), *places)
    epochs = place(rows.join(final, leaf).withColumn("_e", F.explode(F.sequence(F.lit(0), F.col("_whole")))))
    # no edge: the rest is nothing, or all of the epoch
    inside = F.expr("_e < _whole or (_rest > 0 and (_edge is null or _c < _edge or (_c = _edge and _o <= _cut)))")
    return epochs.filter(inside).select(*[F.col("_row")[c].alias(c) for c in cols], F.col("_e").alias("mix_epoch"))
