"""GraphBuilder: documents, tables, rows or triples to a graph, and its upkeep: extend, retract, post-build, row sync."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import cluster, facts, govern, hierarchy, normalize, profile, quality, relations, star
from weftgraph.operators.community import detect_communities
from weftgraph.operators.retract import retract_chunks
from weftgraph.schemas import Graph, conform, empty, graph, place, settled
from weftgraph.session import settle
from weftgraph.sources import documents as D
from weftgraph.sources import grids, rdf
from weftgraph.streaming.sync import diff_rows

STRUCTURAL = (T.RELATED, normalize.LEGACY_RELATED, "sameAs")


@dataclass
class BuildReport:
    """Counts of a build, and what its stages did."""

    mode: str = "basic"
    classes: int = 0
    object_properties: int = 0
    data_properties: int = 0
    instances: int = 0
    relations: int = 0
    data_values: int = 0
    chunks: int = 0
    renamed: int = 0
    predicates_merged: int = 0
    folded: int = 0
    pruned: int = 0
    notes: list[str] = field(default_factory=list)

    def count(self, g: Graph) -> BuildReport:
        for k, v in normalize.stats(g).first().asDict().items():
            setattr(self, k, v)
        return self


@dataclass
class GraphBuilder:
    """mode: basic (rules alone), enrich (a model names relations), llm (a model extracts).

    With an analyzer (``morphology``), prose gives names, values and enumerations, and common words go. ``report`` holds
    the last build's counts, which ``with_report`` asks for; ``check`` is called between stages and may raise.
    """

    spark: SparkSession
    mode: str = "basic"
    client: Callable[[], relations.Model] | None = None
    embedder: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None
    morphology: Callable[[], T.Morphology] = lambda: T.NO_MORPHOLOGY
    dedup: bool = True
    with_hierarchy: bool = True
    resolve: bool = False
    chunk: bool = True
    max_coverage: float = facts.MAX_COVERAGE
    domain: str = ""
    fold: bool = True
    common_rank: int = T.COMMON_RANK
    with_report: bool = False
    report: BuildReport = field(default_factory=BuildReport)
    check: Callable[[], None] = lambda: None

    # documents

    def build(self, docs: DataFrame) -> Graph:
        """docs (doc, text) or chunks (doc, chunk_id, chunk_text, chunk_index)."""
        return self.postprocess(self._extract(D.normalize_documents(docs, self.chunk)))

    def _extract(self, chunks: DataFrame) -> Graph:
        if self.mode == "llm":
            if self.client is None:
                raise ValueError("mode llm needs a client")
            ex = relations.DocumentExtractor(self.client)
            g = graph(self.spark, chunks=chunks, **ex.tables(settle(ex.extract(chunks), "extracted"), self.morphology))
        else:
            prose = chunks.filter(~D.is_table_file(F.col("doc")))
            g = graph(self.spark, chunks=chunks, **facts.extract(prose, self.max_coverage, 1, self.morphology))
            tables = self.tables_of(chunks.filter(D.is_table_file(F.col("doc"))))
            if tables:
                g = normalize.merge(g, self.build_tables(tables))
                g = g.with_(chunks=conform(chunks, "chunks"))
        if self.mode == "enrich":
            if self.client is None:
                raise ValueError("mode enrich needs a client")
            former = relations.RelationFormer(self.client, self.domain)
            units = facts.build_units(chunks, facts.labels_by_chunk(g.classes, g.instances))
            units = settle(units, "units")
            found, words = self._enriched(former, units, chunks)
            new = found.groupBy("subject", "predicate", "object").agg(F.max("label").alias("label"), F.array_sort(F.collect_set("chunk_id")).alias("source_chunks"))
            rel = new.select("subject", "predicate", "object", F.lit("ObjectProperty").alias("predicate_type"), "label", F.lit(1.0).alias("weight"), "source_chunks", place("subject", "predicate", "object").alias("ord"))
            ops = self.spark.createDataFrame([(n, "", "", d, i) for i, (n, d) in enumerate(sorted(words.items()))], "name string, domain string, range string, description string, ord bigint")
            g = g.with_(relations=g.relations.unionByName(conform(rel, "relations")), object_props=g.object_props.unionByName(ops), enriched=units.select("chunk_id").distinct())
        return g

    def _enriched(self, former: relations.RelationFormer, units: DataFrame, chunks: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """Relations of all units, group by group of whole documents: what a group's relations add to the vocabulary, the next group is asked with."""
        words = former.define_vocabulary(units)
        groups = settle(relations.group_documents(chunks), "groups")
        several = groups.agg(F.max("grp")).first()[0] or 0
        found = None
        for k in range(several + 1):
            self.check()
            part = units.join(groups.filter(F.col("grp") == k).select("doc"), "doc", "left_semi") if several else units
            new = settle(former.extract(part, words), "relations")
            found = new if found is None else found.unionByName(new)
            if k < several:
                words = words | {r["predicate"]: "" for r in former.grow_vocabulary(new, words).collect()}  # of a bounded vocabulary
        return found, words

    def tables_of(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """Table documents as frames of text, by doc or doc#sheet=x. Their headers, a line each, come to the driver."""
        bare = D.split_sheets(chunks).withColumn("text", F.regexp_replace("text", f"{D.SHEET}[^\\n]*\\n?", ""))
        rows = settle(bare.select("table", "id", "chunk_index", F.posexplode(grids.table_cell_rows_udf(F.col("text"))).alias("_p", "cells")), "cells")
        first = rows.groupBy("table").agg(F.min_by("cells", F.struct("chunk_index", "_p")).alias("h")).collect()
        out = {}
        for r in first:
            head, seen = [], {}
            for h in map(T.normalize_text, r["h"]):
                seen[h] = seen.get(h, 0) + 1
                head.append(h if seen[h] == 1 else f"{h}_{seen[h]}")
            body = rows.filter((F.col("table") == r["table"]) & (F.size("cells") >= len(head)) & (F.slice("cells", 1, len(head)) != F.array(*map(F.lit, r["h"]))))
            name = r["table"].rsplit("#sheet=", 1)[-1] if "#sheet=" in r["table"] else r["table"].rsplit("/", 1)[-1].rpartition(".")[0] or r["table"]
            out[name] = body.select((F.col("chunk_index").cast("bigint") * (1 << 20) + F.col("_p")).alias("_row"), F.col("id").alias("_chunk"), *[F.get("cells", F.lit(i)).alias(h) for i, h in enumerate(head)])
        return out

    # tables

    def build_tables(self, tables: dict[str, DataFrame]) -> Graph:
        """Inferred schemas: frames of text or of types, ordered by _row where there is one."""
        order = {n: ["_row"] if "_row" in df.columns else df.columns[:1] for n, df in tables.items()}
        own = {n: [c for c in df.columns if c not in ("_row", "_chunk")] for n, df in tables.items()}
        heads = profile.analyze({n: (df.drop("_chunk"), order[n]) for n, df in tables.items()})
        keys: dict[str, str] = {}
        for r in heads["keys"].filter("column <> '_row'").orderBy("table", "ordinal").collect():  # a few rows a table
            keys.setdefault(r["table"], r["column"])
        fks = [r.asDict() for r in heads["fks"].filter("from_column <> '_row' and to_column <> '_row'").collect()]
        cells = None
        for n, df in tables.items():
            part = profile.cells(df.select(*own[n]), [], None, n)
            cells = part if cells is None else cells.unionByName(part)
        labels = {r["table"]: r["column"] for r in profile.label_columns(cells).collect()}  # of all tables in one job
        items = []
        for n, df in tables.items():
            refs = [{"from_column": f["from_column"], "to_table": f["to_table"], "to_column": f["to_column"]} for f in fks if f["from_table"] == n]
            chunk = "_chunk" if "_chunk" in df.columns else None
            place = [F.col("_row").alias("_o")] if order[n] == ["_row"] else []
            rows = df.select(*own[n], *place, *([chunk] if chunk else []))
            items.append(star.Table(n, rows, ["_o"] if place else order[n], keys.get(n), labels.get(n, ""), refs, chunk=chunk))
        g = star.build(self.spark, items)
        hide = lambda df, c: df.filter(F.col(c) != "_o")
        return g.with_(data_props=hide(g.data_props, "name"), data_values=hide(g.data_values, "property"))

    def build_rows(self, table: star.Table) -> Graph:
        """Declared rows: each its own source; foreign keys to rows that are not there make placeholders."""
        return self.postprocess(star.build(self.spark, [table], skip_facts=False), coverage=False)

    def build_triples(self, triples: DataFrame) -> Graph:
        return rdf.from_triples(triples)

    # post-build

    def postprocess(self, g: Graph, coverage: bool = True, protected: DataFrame | None = None) -> Graph:
        """Coverage, dedup, fragments and common words, hierarchy, governance, normalisation, in this order, over the whole graph."""
        analyzer = self.morphology().analyze is not None
        if coverage:
            g = apply_coverage(g, self.max_coverage, protected)
        self.check()
        g = settled(normalize.reconcile_identities(settled(g)))
        names = g.instances.select("name").distinct().count() if self.with_report else 0
        if self.dedup:
            vectors = relations.embed(g.classes.select("name"), self.embedder) if self.embedder else None
            synonyms = relations.class_synonyms(g.classes, self.client) if self.client else None
            g = settled(cluster.deduplicate(g, synonyms, vectors))
        if self.resolve:
            g = settled(normalize.rename_names(g, settle(cluster.resolve_renames(g.instances), "renames")))
        self.check()
        before = [names, g.instances.select("name").distinct().count()] if self.with_report else []
        if self.fold and coverage:
            g = settled(hierarchy.fold_fragments(g))
            before += [g.instances.select("name").distinct().count()] if self.with_report else []
        if analyzer:
            g = settled(hierarchy.prune_common_words(g, self.morphology, self.common_rank))
        if self.with_report:
            after = g.instances.select("name").distinct().count()
            steps = [*before, after]
            self.report = BuildReport(self.mode, renamed=steps[0] - steps[1], folded=steps[1] - steps[2] if self.fold and coverage else 0, pruned=steps[-2] - after)
        if self.with_hierarchy:
            hearst = None
            if analyzer:
                texts = g.chunks.filter("text is not null").select("id", "text")
                hearst = settle(hierarchy.hearst_hierarchy(hierarchy.extract_hearst_pairs(texts, self.morphology), texts, max_coverage=self.max_coverage), "hearst")
            g = settled(hierarchy.induce_hierarchy(g, hearst))
        self.check()
        used = g.relations.select("predicate").distinct().count() if self.with_report else 0
        g = g.with_(relations=govern.govern_predicates(g.relations, g.object_props))
        g = settled(normalize.normalize_graph(settled(g), STRUCTURAL))
        g = hierarchy.fix_self_typed(hierarchy.clean_hierarchy(g))
        if self.with_report:
            g = settled(g)
            self.report.predicates_merged = max(0, used - g.relations.select("predicate").distinct().count())
            self.report.count(g)
        return g

    # upkeep

    def extend(self, g: Graph, docs: DataFrame, retract_missing: bool = False) -> Graph:
        """Chunks whose ids the graph lacks are extracted and merged; with retract_missing, its chunks that docs lack go."""
        chunks = D.normalize_documents(docs, self.chunk)
        new = chunks.join(g.chunks.select("id"), "id", "left_anti").select(*chunks.columns)
        if retract_missing:
            g = self.retract(g, g.chunks.select(F.col("id").alias("chunk_id")).join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti"))
        return self.postprocess(normalize.merge(g, self._extract(new)))

    def retract(self, g: Graph, chunk_ids: DataFrame) -> Graph:
        return retract_chunks(g, chunk_ids, STRUCTURAL)

    def extend_rows(self, g: Graph, table: star.Table) -> Graph:
        """Rows replace what they were before: old statements go, identities are kept together under the new names."""
        new = star.build(self.spark, [table], skip_facts=False)
        ids = new.instances.filter("class_name <> ''").select(F.explode("source_chunks").alias("chunk_id"))
        kept = self.retract(g, ids)
        return self.postprocess(normalize.merge(kept, new), coverage=False)

    def sync_rows(self, g: Graph, table: star.Table, fingerprints: DataFrame, complete: bool = True) -> tuple[Graph, DataFrame]:
        """(graph, new fingerprints): changed rows are loaded, missing ones retracted."""
        diff = diff_rows(table.rows, table.rows.columns, table.key, fingerprints, None, complete)
        load = diff.filter("change in ('added', 'changed')").select("row.*")
        gone = diff.filter("change = 'missing'").select(F.concat(F.lit(f"{table.source_id}:"), "key").alias("chunk_id"))
        part = star.Table(table.name, load, table.order, table.key, table.label, table.fks, table.source_id)
        out = self.extend_rows(g, part)
        return self.retract(out, gone), diff.filter("fingerprint is not null").select("key", "fingerprint")

    # reports

    def quality(self, g: Graph) -> DataFrame:
        return quality.review_quality(g)

    def communities(self, g: Graph) -> DataFrame:
        return detect_communities(g)


def apply_coverage(g: Graph, max_coverage: float = facts.MAX_COVERAGE, protected: DataFrame | None = None) -> Graph:
    """Without unprotected instances that more than ``max_coverage`` of a large enough corpus names, and what is said of them."""
    n = g.chunks.count()
    if n < facts.COVERAGE_FROM:
        return g
    per = g.instances.select("name", F.explode("source_chunks").alias("c")).groupBy("name").agg(F.countDistinct("c").alias("k"))
    wide = per.filter((F.col("k") > 1) & (F.col("k") / n > max_coverage)).select("name")
    if protected is not None:
        wide = wide.join(protected.select("name"), "name", "left_anti")
    return hierarchy.without_names(g, wide)


def new_graph(spark: SparkSession) -> Graph:
    return empty(spark)
