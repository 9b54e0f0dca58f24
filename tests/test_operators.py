"""Small fixtures: communities, hierarchy, retraction, dictionary, lineage cuts."""

import random

from pyspark.sql import functions as F

from weftgraph.functions import dictionary
from weftgraph.operators import cluster, community, hierarchy
from weftgraph.operators.retract import retract_chunks
from weftgraph.plans.builder import STRUCTURAL
from weftgraph.schemas import graph
from weftgraph.session import settle, shared_dir
from weftgraph.sources import documents


def relations(spark, rows):
    return spark.createDataFrame([(s, p, o, "ObjectProperty", None, 1.0, c, i) for i, (s, p, o, c) in enumerate(rows)], "subject string, predicate string, object string, predicate_type string, label string, weight double, source_chunks array<string>, ord bigint")


def instances(spark, rows):
    return spark.createDataFrame([(n, k, "", c, i) for i, (n, k, c) in enumerate(rows)], "name string, class_name string, identity string, source_chunks array<string>, ord bigint")


def test_two_triangles_are_two_communities(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    g = graph(spark, relations=relations(spark, [(a, "p", b, []) for a, b in edges]), instances=instances(spark, [(n, "N", []) for n in "abcdef"]))
    assert sorted(sorted(r["members"]) for r in community.detect_communities(g).collect()) == [["a", "b", "c"], ["d", "e", "f"]]


def test_components_follow_long_chains(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in cluster.components(links).collect()} == {0}


def test_retraction_keeps_what_other_chunks_state(spark):
    g = graph(spark, instances=instances(spark, [("X", "K", ["c1"]), ("Y", "K", ["c1", "c2"]), ("Z", "K", ["c2"])]), relations=relations(spark, [("X", "p", "Y", ["c1"]), ("Y", "p", "Z", ["c2"])]))
    out = retract_chunks(g, spark.createDataFrame([("c1",)], "chunk_id string"), STRUCTURAL)
    assert {(r["name"], tuple(r["source_chunks"])) for r in out.instances.collect()} == {("Y", ("c2",)), ("Z", ("c2",))}
    assert [(r["subject"], r["object"]) for r in out.relations.collect()] == [("Y", "Z")]


def test_retraction_looks_at_every_class_edge_and_name(spark):
    rows = spark.range(110_000)
    cls = lambda letter, chunk: rows.select(F.concat(F.lit(letter), F.col("id").cast("string")).alias("name"), F.array(F.lit(chunk)).alias("source_chunks"), F.col("id").alias("ord"))
    edges = rows.select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("parent"), F.concat(F.lit("K"), F.col("id").cast("string")).alias("child"), F.col("id").alias("ord"))
    g = graph(spark, classes=cls("P", "c1").unionByName(cls("K", "c2")).unionByName(cls("D", "c1")), hierarchy=edges)
    out = retract_chunks(g, spark.createDataFrame([("c1",)], "chunk_id string"), STRUCTURAL)
    assert {r["k"]: r["count"] for r in out.classes.groupBy(F.left("name", F.lit(1)).alias("k")).count().collect()} == {"P": 110_000, "K": 110_000}
    assert out.hierarchy.count() == 110_000


def test_retraction_of_classes_to_a_fixpoint(spark):
    # A over B over C go one by one, with R, the range of a property of A; S has a chunk left, T a typed instance, U a child, V a relation
    made = [("A", None, ["c1"]), ("B", "A", []), ("C", "B", ["c1"]), ("R", None, []), ("S", None, ["c2"]), ("T", None, ["c1"]), ("U", None, ["c1"]), ("V", None, ["c1"]), ("W", "C", ["c1"]), ("W", "U", ["c1"]), ("Y", "U", ["c2"])]
    classes = spark.createDataFrame([(n, p, c, i) for i, (n, p, c) in enumerate(made)], "name string, parent string, source_chunks array<string>, ord bigint")
    props = spark.createDataFrame([("p", "A", "R", 0), ("q", "S", "T", 1)], "name string, domain string, range string, ord bigint")
    edges = spark.createDataFrame([("A", "B", 0), ("B", "C", 1), ("U", "Y", 2)], "parent string, child string, ord bigint")
    inst = instances(spark, [("x", "S", ["c1"]), ("y", "T", ["c2"]), ("z", "C", ["c1"])])
    rel = relations(spark, [("V", STRUCTURAL[0], "y", [])])
    out = retract_chunks(graph(spark, classes=classes, object_props=props, hierarchy=edges, instances=inst, relations=rel), spark.createDataFrame([("c1",)], "chunk_id string"), STRUCTURAL)
    assert {(r["name"], r["parent"]) for r in out.classes.collect()} == {("S", None), ("T", None), ("U", None), ("V", None), ("Y", "U")}
    assert {r["name"] for r in out.object_props.collect()} == {"q"}
    assert {(r["parent"], r["child"]) for r in out.hierarchy.collect()} == {("U", "Y")}


def test_circles_go_in_order(spark):
    edges = spark.createDataFrame([("A", "B", 0), ("B", "C", 1), ("C", "A", 2), ("A", "A", 3)], "parent string, child string, ord bigint")
    classes = spark.createDataFrame([(n, i) for i, n in enumerate("ABC")], "name string, ord bigint")
    out = hierarchy.clean_hierarchy(graph(spark, hierarchy=edges, classes=classes)).hierarchy.collect()
    assert {(r["parent"], r["child"]) for r in out} == {("A", "B"), ("B", "C")}


def test_terms_are_whole_words(spark):
    df = spark.createDataFrame([("use the LC and lcx, lc",), ("LC(letter) done",), ("élc",)], "t string")
    terms = [("lc", "letter")]
    assert [r[0] for r in df.select(dictionary.normalize_text(F.col("t"), terms)).collect()] == ["use the lc(letter) and lcx, lc(letter)", "LC(letter) done", "élc"]
    assert [r[0] for r in df.select(dictionary.normalize_query(F.col("t"), terms)).collect()] == ["use the LC and lcx, lc letter", "LC(letter) done", "élc"]
    assert df.select(dictionary.normalize_query(F.col("t"), terms, "replace")).first()[0] == "use the letter and lcx, letter"


def test_settled_frames_stand_on_files_of_the_shared_folder(spark):
    df = settle(spark.range(5))
    assert settle(df) is df and df.count() == 5
    assert shared_dir(spark).removeprefix("file://") in df.inputFiles()[0]


def chunked(text, most, overlap):
    """Brute force: paragraphs by lines, sentences by characters, then packed."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n").strip()
    if len(text) <= most:
        return [text] if text else []
    paragraphs = [[]]
    for line in text.split("\n"):
        paragraphs[-1].append(line) if line.strip() else paragraphs.append([])
    units = []
    for p in ("\n".join(x).strip() for x in paragraphs):
        sentences = [""]
        for i, c in enumerate(p):
            if len(p) > most and (c == "\n" or c == " " and i and p[i - 1] in ".!?。！？"):
                sentences.append("")
            else:
                sentences[-1] += c
        for s in map(str.strip, sentences):
            while s:
                units.append(s[:most])
                s = s[most:]
    out = []
    for u in units:
        if out and len(out[-1]) + 1 + len(u) <= most:
            out[-1] += "\n" + u
        elif out:
            end = out[-1][-overlap:]
            if len(out[-1]) > overlap and " " in end[: overlap // 2]:
                end = end[end.index(" ") + 1 :]
            out.append(end + "\n" + u)
        else:
            out.append(u)
    return [c.strip() for c in out if c.strip()]


def test_long_documents_are_chunked_as_by_brute_force(spark):
    rng = random.Random(5)
    sentence = lambda: " ".join("x" * rng.randint(1, 9) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))) + rng.choice(".!?。")
    paragraph = lambda: rng.choice([" ", "\n", "\r\n"]).join(sentence() for _ in range(rng.randint(1, 20)))
    texts = [rng.choice(["\n\n", "\n  \n"]).join(paragraph() for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += ["y" * 5000, "a " * 3000, "z" * 1200, "z" * 1201, " \n ", "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc string, text string")
    got = {(r["chunk_id"], r["doc"], r["chunk_index"], r["chunk_text"]) for r in documents.chunk_documents(df).collect()}
    want = {(f"{i}#{k}", str(i), k, c) for i, t in enumerate(texts) for k, c in enumerate(chunked(t, 1200, 150))}
    assert got == want and len(want) > 100
