"""Class hierarchies: from name structure and from enumerations, cleaned of cycles, with inherited properties; and name fragments.

What needs an order over edges is the breaking of circles alone. Edges that lie in no circle are told by joins, level by
level; only the rest, few in a sound schema, is ordered on the driver (MAX_EDGES, checked).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, groupby, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import text as T
from weftgraph.operators.facts import COVERAGE_FROM, MAX_COVERAGE
from weftgraph.schemas import LAYOUT, Graph, conform
from weftgraph.session import settle
from weftgraph.sources.grids import prose_only

#: Edges within circles that are ordered on the driver, at most, and edges that go there at once, without a look for circles.
MAX_EDGES, FEW_EDGES = 200_000, 20_000


def in_circles(edges: DataFrame) -> DataFrame:
    """The edges (parent, child, ord) that are left when those from or to a name without another end go, again and again."""
    n = edges.count()
    while True:
        inner = edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        inner = inner.join(edges.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child", "ord")
        edges = settle(inner, "circles")
        left = edges.count()
        if left == n:
            return edges
        n = left


def _ordered(edges: DataFrame) -> list:
    rows = edges.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"over {MAX_EDGES} edges within circles: instances must have been taken for classes")
    return sorted(rows, key=lambda r: (r["ord"], r["parent"], r["child"]))


def breakers(rows: list) -> set[tuple[str, str, int]]:
    """Of edges in order, those that repeat one or close a circle of edges before them."""
    up: dict[str, set[str]] = {}
    out = set()
    for r in rows:
        p, c = r["parent"], r["child"]
        above, todo = set(), [p]
        while todo:
            x = todo.pop()
            if x not in above:
                above.add(x)
                todo += up.get(x, ())
        if c in above or p in up.get(c, ()):
            out.add((p, c, r["ord"]))
        else:
            up.setdefault(c, set()).add(p)
    return out


def clean_hierarchy(g: Graph, few: int = FEW_EDGES) -> Graph:
    """Edges between classes, without loops and repeats; in order, an edge that closes a circle goes. A class's parent is its last."""
    names = g.classes.select("name").distinct()
    edges = g.hierarchy.join(names.withColumnRenamed("name", "parent"), "parent", "left_semi").join(names.withColumnRenamed("name", "child"), "child", "left_semi")
    once = edges.filter("parent <> child").groupBy("parent", "child").agg(F.min("ord").alias("ord"))
    once = settle(once, "edges")
    gone = breakers(_ordered(once if once.limit(few + 1).count() <= few else in_circles(once)))
    kept = once
    if gone:  # a row for each circle
        kept = once.join(F.broadcast(g.spark.createDataFrame(sorted(gone), LAYOUT["hierarchy"])), ["parent", "child", "ord"], "left_anti")
    kept = settle(conform(kept, "hierarchy"), "hierarchy")
    parents = kept.groupBy(F.col("child").alias("name")).agg(F.max_by("parent", "ord").alias("_p"))
    classes = g.classes.join(parents, "name", "left").withColumn("parent", F.col("_p"))
    return g.with_(hierarchy=kept, classes=conform(classes, "classes"))


def fix_self_typed(g: Graph) -> Graph:
    """An instance typed by its own name gets that class's parent, or no type."""
    up = g.hierarchy.groupBy(F.col("child").alias("name")).agg(F.max_by("parent", "ord").alias("_up"))
    inst = g.instances.join(up, "name", "left").withColumn("class_name", F.when(F.col("class_name") == F.col("name"), F.coalesce("_up", F.lit(""))).otherwise(F.col("class_name")))
    w = W.partitionBy("name", "class_name").orderBy("ord")
    return g.with_(instances=conform(inst.withColumn("_n", F.row_number().over(w)).filter("_n = 1"), "instances"))


def closure(hierarchy: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth), the shortest way, level by level until a level has nothing new; circles end by that."""
    edges = settle(hierarchy.filter("parent <> child").select("parent", "child").distinct(), "edges")
    fresh = edges.select(F.col("child").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    seen, depth = fresh, 1
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    while fresh.limit(1).count():
        depth += 1
        wider = fresh.join(up, "ancestor").select("descendant", F.col("_next").alias("ancestor")).distinct().filter("descendant <> ancestor")
        fresh = settle(wider.join(seen, ["descendant", "ancestor"], "left_anti").select("descendant", "ancestor", F.lit(depth).alias("depth")), "level")
        seen = seen.unionByName(fresh)
    return seen


def inherit_properties(g: Graph) -> Graph:
    """Subclasses get copies of ancestors' properties whose names they lack, from the nearest."""
    up = closure(g.hierarchy)

    def down(props: DataFrame, kind: str) -> DataFrame:
        own = props.select("name", F.col("domain").alias("descendant")).distinct()
        got = up.join(props.withColumnRenamed("domain", "ancestor"), "ancestor").join(own, ["name", "descendant"], "left_anti")
        w = W.partitionBy("descendant", "name").orderBy("depth", "ord")
        near = got.withColumn("_n", F.row_number().over(w)).filter("_n = 1").withColumn("domain", F.col("descendant")).withColumn("ord", F.col("ord") + (1 << 60))
        return conform(props, kind).unionByName(conform(near, kind))

    return g.with_(object_props=down(g.object_props, "object_props"), data_props=down(g.data_props, "data_props"))


def head_noun_edges(labels: DataFrame, chunks_of: DataFrame | None = None, corpus_chunks: int = 0, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(child, head, kind) of labels (name): the longest tail of words that is a label.

    kind: edge; sameAs where what goes before is a code; related where the head is in too many chunks.
    """
    from weftgraph.operators.facts import tails

    names = labels.select("name").distinct()
    cand = names.select(F.col("name").alias("child"), F.posexplode(tails(F.col("name"))).alias("place", "head"))
    found = cand.join(names.withColumnRenamed("name", "head"), "head", "left_semi").filter("child <> head and length(head) >= 2")
    first = found.groupBy("child").agg(F.min_by("head", "place").alias("head"))
    lead = F.trim(F.expr("left(child, length(child) - length(head))"))
    code = lead.rlike("^(?=\\S*\\d)[A-Za-z0-9][A-Za-z0-9.\\-]*$")
    out = first.withColumn("kind", F.when(F.endswith("child", F.col("head")) & code, "sameAs").otherwise("edge"))
    if chunks_of is not None and corpus_chunks >= COVERAGE_FROM:
        members = first.select("head", F.col("child").alias("name")).unionByName(first.select("head", F.col("head").alias("name")).distinct())
        wide = members.join(chunks_of, "name").groupBy("head").agg(F.countDistinct("chunk_id").alias("c")).filter(F.col("c") / corpus_chunks > max_coverage).select("head", F.lit(True).alias("_wide"))
        out = out.join(wide, "head", "left").withColumn("kind", F.when(F.col("_wide") & (F.col("kind") == "edge"), "related").otherwise(F.col("kind"))).drop("_wide")
    return out.select("child", "head", "kind")


def induce_hierarchy(g: Graph, hearst: DataFrame | None = None) -> Graph:
    """Heads of instance names become classes of these; codes fold into sameAs; generic heads relate. hearst: (parent, child) pairs."""
    labels = g.instances.select("name").unionByName(g.classes.select("name"))
    from weftgraph.schemas import evidence

    n = g.chunks.count()
    edges = head_noun_edges(labels, evidence(g), n)
    typed = edges.filter("kind = 'edge'")
    is_class = g.classes.select(F.col("name").alias("child")).distinct()
    class_edges = typed.join(is_class, "child", "left_semi").select(F.col("head").alias("parent"), "child")
    inst_edges = typed.join(is_class, "child", "left_anti")
    if hearst is not None:
        class_edges = class_edges.unionByName(hearst.select("parent", "child"))
    names = typed.select(F.col("head").alias("name")).unionByName(class_edges.select(F.col("parent").alias("name"))).distinct().join(g.classes.select("name"), "name", "left_anti")
    at = lambda *c: ((1 << 61) + F.pmod(F.xxhash64(*c), F.lit(1 << 40))).cast("bigint").alias("ord")
    classes = conform(g.classes, "classes").unionByName(conform(names.select("name", F.lit("").alias("description"), F.lit("").alias("source"), F.array().cast("array<string>").alias("source_chunks"), at("name")), "classes"))
    head_of = inst_edges.select(F.col("child").alias("name"), "head")
    heads = names.withColumn("_class", F.lit(True))
    inst = g.instances.join(head_of, "name", "left").join(heads, "name", "left").filter("_class is null")
    untyped = F.coalesce("class_name", F.lit("")) == ""
    same = inst.withColumn("class_name", F.when(untyped, F.coalesce("head", F.lit(""))).otherwise(F.col("class_name")))
    extra = inst.filter(~untyped & F.col("head").isNotNull() & (F.col("head") != F.col("class_name"))).withColumn("class_name", F.col("head")).withColumn("ord", F.col("ord") + (1 << 60))
    instances = conform(same, "instances").unionByName(conform(extra, "instances"))
    made = edges.filter("kind <> 'edge'").select(F.col("child").alias("subject"), F.when(F.col("kind") == "sameAs", "sameAs").otherwise(T.RELATED).alias("predicate"), F.col("head").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(1.0).alias("weight"), F.array().cast("array<string>").alias("source_chunks"), at("child", "head"))
    relations = conform(g.relations, "relations").unionByName(conform(made, "relations"))
    hierarchy = conform(g.hierarchy, "hierarchy").unionByName(conform(class_edges.distinct().select("parent", "child", at("parent", "child")), "hierarchy"))
    return clean_hierarchy(g.with_(classes=classes, instances=instances, relations=relations, hierarchy=hierarchy))


# The noun that ends an enumeration, tags of its separators and of brackets, and "related to".
ETC, SEPARATORS, OPENING, CLOSING, RELATED_NOUN, WITH = ("등", "NNB"), frozenset(("SP", "MAG")), "SSO", "SSC", "관련", frozenset(("와", "과"))
ENUMERATED, NAME_CHARS = frozenset(("NNG", "NNP", "SL", "SN")), (2, 20)


def hearst_pairs(text: str | None, morphology: T.Morphology) -> list[tuple[str, str]]:
    """(hyponym, hypernym) of "A, B etc. C": the nouns before the word, in one line, are kinds of the noun after it.

    Not within brackets, where it is a title's; not if the noun after it makes a verb or an adjective, or is followed by "related to".
    """
    if morphology.analyze is None or ETC[0] not in (text or ""):
        return []
    tokens, opened, inside = morphology.tokens(text), [], set()
    for i, t in enumerate(tokens):  # a bracket that nothing closes opens nothing
        if t.tag == OPENING:
            opened.append(i)
        elif t.tag == CLOSING and opened:
            inside |= set(range(opened.pop(), i))
    line = list(accumulate(("\n" in text[a.end : b.start] for a, b in pairwise(tokens)), initial=0))
    name = lambda ts: "".join(t.form for t in ts)
    fits = lambda s: NAME_CHARS[0] <= len(s) <= NAME_CHARS[1] and T.is_name_shape(s)
    tag = lambda i: tokens[i].tag if i < len(tokens) else ""
    out = []
    for i, t in enumerate(tokens):
        if (t.form, t.tag) != ETC or i in inside:
            continue
        start = next((k for k in range(i + 1, len(tokens)) if not tokens[k].tag.startswith("J")), len(tokens))
        end = next((k for k in range(start, len(tokens)) if tokens[k].tag not in ENUMERATED or line[k] != line[start]), len(tokens))
        hypernym = name(tokens[start:end])
        about = end + 1 < len(tokens) and tokens[end].form in WITH and tag(end).startswith("J") and tokens[end + 1].form == RELATED_NOUN
        if not fits(hypernym) or tag(end) in T.DERIVED or about:
            continue
        begin = next((k + 1 for k in range(i - 1, -1, -1) if tokens[k].tag not in ENUMERATED | SEPARATORS or line[k] != line[i]), 0)
        for noun, group in groupby(tokens[begin:i], key=lambda x: x.tag in ENUMERATED):
            hyponym = name(group)
            if noun and fits(hyponym) and hyponym != hypernym:
                out.append((hyponym, hypernym))
    return out


def extract_hearst_pairs(chunks: DataFrame, morphology: Callable[[], T.Morphology]) -> DataFrame:
    """(id, hyponym, hypernym) of the prose of chunks (id, text); texts without the enumerating noun are not sent to Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = morphology()
        for pdf in batches:
            rows = [(i, *pair) for i, t in zip(pdf["id"], pdf["text"], strict=True) for pair in hearst_pairs(prose_only(t), m)]
            yield pd.DataFrame(rows, columns=["id", "hyponym", "hypernym"])

    return chunks.select("id", "text").filter(F.contains("text", F.lit(ETC[0]))).mapInPandas(run, "id string, hyponym string, hypernym string")


def hearst_hierarchy(pairs: DataFrame, texts: DataFrame, min_hyponyms: int = 2, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """(parent, child) of pairs (id, hyponym, hypernym) over texts (id, text): hypernyms that not too many texts hold; a hypernym that
    begins with another one is that; those with enough hyponyms, and of a child's the one with most."""
    n = max(1, texts.count())
    pairs = settle(pairs.select("hyponym", "hypernym").distinct(), "pairs")
    names = pairs.select("hypernym").distinct()
    # a text that holds a name holds its first two signs there: they meet by these, then are compared
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1))), lambda i: F.substr(F.col("text"), i, F.lit(2))))
    starts = names.select(F.substring("hypernym", 1, 2).alias("g"), "hypernym")
    held = texts.select("id", "text", F.explode(grams).alias("g")).join(starts, "g").filter(F.contains("text", F.col("hypernym"))).groupBy("hypernym").agg(F.countDistinct("id").alias("c"))
    wide = held.filter(F.col("c") / n > max_coverage).select("hypernym")
    fine = names.join(wide, "hypernym", "left_anti")
    heads = fine.select("hypernym", F.explode(F.transform(F.sequence(F.lit(1), F.length("hypernym")), lambda k: F.substr(F.col("hypernym"), F.lit(1), k))).alias("parent"))
    parent = heads.join(fine.select(F.col("hypernym").alias("parent")), "parent").groupBy("hypernym").agg(F.min_by("parent", F.length("parent")).alias("parent"))
    told = settle(pairs.join(parent, "hypernym").select("parent", F.col("hyponym").alias("child")).distinct(), "told")
    enough = told.groupBy("parent").agg(F.count("*").alias("k")).filter(F.col("k") >= min_hyponyms)
    votes = told.join(enough, "parent").filter(~F.contains("child", F.col("parent")) & ~F.contains("parent", F.col("child")))
    return votes.groupBy("child").agg(F.min_by("parent", F.struct(-F.col("k"), "parent")).alias("parent")).select("parent", "child")


def fragment_renames(names: DataFrame, chunks_of: DataFrame, linked: DataFrame) -> DataFrame:
    """(name, canonical): an unlinked name of 2 to 20 characters goes into a longer name that begins or ends with it, not as a
    word of it, and is in all its chunks; into the longest. Begins and ends come by equi-join of pieces."""
    frag = names.filter("length(name) between 2 and 20").join(linked, "name", "left_anti").select(F.col("name").alias("frag"))
    longest = names.filter("length(name) between 3 and 80")
    cut = F.sequence(F.lit(2), F.least(F.length("name") - 1, F.lit(20)))
    ends = F.array_distinct(F.concat(F.transform(cut, lambda k: F.substr(F.col("name"), F.lit(1), k)), F.transform(cut, lambda k: F.substr(F.col("name"), F.length("name") - k + 1, k))))
    held = longest.select(F.col("name").alias("holder"), F.explode(ends).alias("frag")).join(frag, "frag", "left_semi")
    held = held.filter(~F.array_contains(F.split("holder", "\\s+"), F.col("frag")))
    mine = chunks_of.select(F.col("name").alias("frag"), "chunk_id").join(held.select("frag").distinct(), "frag", "left_semi")
    size = mine.groupBy("frag").agg(F.count("*").alias("n"))
    common = held.join(mine, "frag").join(chunks_of.select(F.col("name").alias("holder"), "chunk_id"), ["holder", "chunk_id"], "left_semi").groupBy("frag", "holder").agg(F.count("*").alias("c"))
    inside = common.join(size, "frag").filter("c = n")
    best = inside.groupBy("frag").agg(F.max(F.struct(F.length("holder"), "holder")).alias("m"))
    from weftgraph.operators.cluster import flatten_renames

    return flatten_renames(best.select(F.col("frag").alias("name"), F.col("m.holder").alias("canonical")))


def common_words(names: DataFrame, linked: DataFrame, morphology: Callable[[], T.Morphology], rank: int = T.COMMON_RANK) -> DataFrame:
    """(name) of unlinked names of 2 to 8 characters that are one common noun of an analyzer's dictionary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = morphology()
        for pdf in batches:
            yield pdf[[m.common(n, rank) for n in pdf["name"]]]

    short = names.select("name").distinct().filter("length(name) between 2 and 8").join(linked, "name", "left_anti")
    return short.mapInPandas(run, "name string")


def linked_names(g: Graph) -> DataFrame:
    """(name) of ends of relations and of entities with values."""
    ends = g.relations.select(F.explode(F.array("subject", "object")).alias("name")).unionByName(g.data_values.select(F.col("entity").alias("name")))
    return ends.filter("coalesce(name, '') <> ''").distinct()


def without_names(g: Graph, names: DataFrame) -> Graph:
    """Without instances of these names and what is said of them."""
    cut = lambda df, c: df.join(names.select(F.col("name").alias(c)), c, "left_anti").select(*df.columns)
    return g.with_(instances=cut(g.instances, "name"), relations=cut(cut(g.relations, "subject"), "object"), data_values=cut(g.data_values, "entity"))


def prune_common_words(g: Graph, morphology: Callable[[], T.Morphology], rank: int = T.COMMON_RANK) -> Graph:
    return without_names(g, settle(common_words(g.instances, linked_names(g), morphology, rank), "common"))


def fold_fragments(g: Graph) -> Graph:
    """Instances whose names are fragments of others' become these; their chunks go along."""
    from weftgraph.operators.normalize import rename_names

    chunks_of = g.instances.select("name", F.explode("source_chunks").alias("chunk_id")).distinct()
    names = g.instances.select("name").distinct()
    renames = settle(fragment_renames(names, chunks_of, linked_names(g)), "fragments")
    return rename_names(g, renames) if renames.limit(1).count() else g
