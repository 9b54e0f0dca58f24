"""Steps whose cost must grow with the input alone."""

import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.operators import cluster
from weftgraph.operators.retract import retract_chunks
from weftgraph.plans import queries
from weftgraph.plans.builder import STRUCTURAL
from weftgraph.schemas import graph
from weftgraph.sources import grids


def test_pipe_tables_of_many_lines_are_read_in_linear_time(spark):
    rng = random.Random(3)
    odd = ["|", "\\|", "a", " ", "||", "x | y", ":-", "\\", "|||\\||"]
    texts = ["\n".join("".join(rng.choice(odd) for _ in range(rng.randint(1, 9))) + "z|" for _ in range(rng.randint(1, 12))) for _ in range(200)]
    texts += ["\n".join(f"| {i} | a{i} |" + " b |" * (i % 3) for i in range(6000)), "a|b\n" + "|" * 40_000 + "c|d", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    began = time.time()
    got = {r["id"]: r["rows"] for r in df.select("id", grids.pipe_table(F.col("t")).alias("rows")).collect()}
    assert time.time() - began < 60
    # spaces alone are trimmed from cells, as they were
    assert [got[i] for i in range(len(texts))] == [[[c.strip() for c in r] for r in grids.parse_pipe_table(t)] for t in texts]


def test_retraction_never_hands_a_hub_s_chunks_to_its_relations(spark):
    n = 6000
    ids = spark.range(n).select(F.concat(F.lit("x"), "id").alias("name"), F.concat(F.lit("c"), "id").alias("chunk"), F.col("id").alias("ord"))
    rel = ids.select(F.col("name").alias("subject"), F.lit("p").alias("predicate"), F.lit("hub").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.array("chunk").alias("source_chunks"), "ord")
    # a relation and a value without sources live on what both ends keep; one whose ends share nothing goes
    more = spark.createDataFrame([("x1", "q", "hub", "ObjectProperty", [], n), ("y", "q", "hub", "ObjectProperty", [], n + 1), ("x3", "v", "hub", "DatatypeProperty", ["c0"], n + 2)], rel.schema)
    inst = ids.select("name", F.array("chunk", F.lit("c0")).alias("source_chunks"), "ord").unionByName(spark.createDataFrame([("y", ["c0", "e"], n), ("hub", ["f"], n + 1)], "name string, source_chunks array<string>, ord bigint"))
    before = len(session._written)
    out = retract_chunks(graph(spark, instances=inst, relations=rel.unionByName(more)), spark.createDataFrame([("c0",)], "chunk_id string"), STRUCTURAL)
    got = {(r["subject"], r["predicate"]): r["source_chunks"] for r in out.relations.filter("predicate <> 'p' or subject in ('x1', 'x2')").collect()}
    assert got == {("x1", "p"): ["c1"], ("x2", "p"): ["c2"], ("x1", "q"): ["c1"], ("x3", "v"): ["c3"]}
    assert out.relations.filter("predicate = 'p'").count() == n - 1
    assert sum(f.stat().st_size for _, p in session._written[before:] for f in Path(p.removeprefix("file://")).iterdir()) < 3_000_000


def test_cosine_links_are_those_of_brute_force_and_copy_no_vector(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 6)).round(1)
    m[::50] = m[7]  # copies
    m[11] = 0
    rows = [(f"v{i}", list(map(float, v))) for i, v in enumerate(m)] + [("v7", list(map(float, m[7]))), ("none", None)]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    unit = m.astype(np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
    want = {tuple(sorted((f"v{a}", f"v{b}"))) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.7 - 1e-12), strict=True) if a != b}
    for block in (64, None):
        links = cluster.cosine_links(df, 0.7, block)
        got = [tuple(r) for r in links.collect()]
        assert set(got) == want and len(got) == len(want) > 300
        assert "explode" not in links._jdf.queryExecution().toString()
    assert cluster.cosine_links(df.limit(0)).count() == 0


def test_reads_of_the_stored_graph_write_no_table_they_do_not_read(spark):
    before = len(session._written)
    rows = queries.predicates(spark, "/root/testdata/sf0.001").collect() + queries.search_labels(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 3
    tags = [Path(p).name for _, p in session._written[before:]]
    assert not {"nodes", "edges", "node_chunks"} & set(tags) and tags.count("endpoints") == 2
