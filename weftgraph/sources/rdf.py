"""RDF out: triples as a frame, Turtle and RDF/XML as lines, and sinks for them."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import text as T
from weftgraph.functions import values as V
from weftgraph.schemas import Graph

SCHEMA, INSTANCE = "urn:weft:schema#", "urn:weft:instance#"
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
OWL, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"": SCHEMA, "inst": INSTANCE, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}


def to_rdf_triples(g: Graph, source_chunks: bool = True) -> DataFrame:
    """(s, p, o, o_is_literal, datatype, lang). Of relations between two nodes the first alone is told; numbers are no nodes."""
    trans = g.translations.groupBy("name").agg(F.first("translation").alias("_t"))

    def uri(df: DataFrame, col: str, is_class: bool) -> Column:
        del df
        return F.concat(F.lit(SCHEMA), T.english_local_name(F.col(col), F.col(f"_t_{col}"), is_class))

    def named(df: DataFrame, *cols: str) -> DataFrame:
        for c in cols:
            df = df.join(trans.select(F.col("name").alias(c), F.col("_t").alias(f"_t_{c}")), c, "left")
        return df

    inst = lambda c: F.concat(F.lit(INSTANCE), T.safe_uri(F.col(c)))

    def row(df: DataFrame, s: Column, p: str | Column, o: Column | str, literal: bool = False, datatype: Column | str = "") -> DataFrame:
        c = lambda x: x if isinstance(x, Column) else F.lit(x)
        return df.select(s.alias("s"), c(p).alias("p"), c(o).cast("string").alias("o"), F.lit(literal).alias("o_is_literal"), c(datatype).alias("datatype"), F.lit("").alias("lang"))

    full = lambda df, c: df.filter(F.coalesce(F.col(c), F.lit("")) != "")
    names = full(g.classes, "name").select("name").distinct()
    is_class = lambda df, c: df.join(names.withColumnRenamed("name", c), c, "left_semi")
    out = []
    cls = named(full(g.classes, "name"), "name")
    u = uri(cls, "name", True)
    out += [row(cls, u, RDF + "type", OWL + "Class"), row(cls, u, RDFS + "label", F.col("name"), True), row(full(cls, "description"), u, RDFS + "comment", F.col("description"), True)]
    up = named(is_class(is_class(g.hierarchy.filter("parent <> child"), "parent"), "child"), "parent", "child")
    out.append(row(up, uri(up, "child", True), RDFS + "subClassOf", uri(up, "parent", True)))
    for props, kind in ((g.object_props, "ObjectProperty"), (g.data_props, "DatatypeProperty")):
        p = named(full(props, "name"), "name")
        u = uri(p, "name", False)
        out += [row(p, u, RDF + "type", OWL + kind), row(p, u, RDFS + "label", F.col("name"), True)]
        d = named(is_class(p, "domain"), "domain")
        out.append(row(d, uri(d, "name", False), RDFS + "domain", uri(d, "domain", True)))
        if kind == "ObjectProperty":
            r = named(is_class(p, "range"), "range")
            out.append(row(r, uri(r, "name", False), RDFS + "range", uri(r, "range", True)))
        else:
            kind_of = F.coalesce(F.nullif(F.col("range"), F.lit("")), F.lit("xsd:string"))
            out.append(row(p.filter(F.startswith(kind_of, F.lit("xsd:"))), u, RDFS + "range", F.concat(F.lit(XSD), F.substr(kind_of, F.lit(5)))))
    i = named(full(g.instances, "name"), "class_name")
    out += [row(i, inst("name"), RDF + "type", OWL + "NamedIndividual"), row(full(i, "class_name"), inst("name"), RDF + "type", uri(i, "class_name", True)), row(i, inst("name"), RDFS + "label", F.col("name"), True)]
    if source_chunks:
        c = i.select("name", F.explode("source_chunks").alias("c")).filter("c <> ''")
        out.append(row(c, inst("name"), SCHEMA + "sourceChunk", F.col("c"), True))
    rel = named(full(full(full(g.relations, "subject"), "predicate"), "object"), "predicate")
    p = uri(rel, "predicate", False)
    is_value = F.col("predicate_type") == "DatatypeProperty"
    out.append(row(rel.filter(is_value), inst("subject"), p, F.col("object"), True))
    nodes = rel.filter(F.coalesce(~is_value, F.lit(True)) & (F.trim("object") != "") & ~F.trim("object").rlike("^-?\\d+\\.?\\d*$")).withColumn("_s", inst("subject")).withColumn("_o", inst("object"))
    first = nodes.withColumn("_n", F.row_number().over(W.partitionBy("_s", "_o").orderBy("ord"))).filter("_n = 1")
    out.append(row(first, F.col("_s"), p, F.col("_o")))
    unknown = first.join(full(g.instances, "name").select(F.col("name").alias("object")), "object", "left_anti").select("object", "_o").distinct()
    out += [row(unknown, F.col("_o"), RDF + "type", OWL + "NamedIndividual"), row(unknown, F.col("_o"), RDFS + "label", F.col("object"), True)]
    v = named(full(full(g.data_values, "entity"), "property").filter("trim(coalesce(value, '')) <> ''"), "property")
    text = V.clean_value(F.trim("value"))
    v = v.withColumn("_v", V.normalize_date(text))
    kind = F.coalesce(F.nullif(F.col("value_type"), F.lit("")), F.lit("xsd:string"))
    kind = F.when(kind == "xsd:string", V.auto_xsd_type(F.col("_v"))).otherwise(kind)
    number = F.expr("try_cast(_v AS double)")
    whole = F.expr("CASE WHEN _v LIKE '%.%' THEN try_cast(try_cast(_v AS double) AS bigint) ELSE try_cast(_v AS bigint) END")
    yes = F.lower("_v").isin("true", "1", "yes")
    v = v.withColumn("_k", kind)
    date, day = F.contains("_k", F.lit("date")), F.col("_v").rlike("^\\d{4}-\\d{2}-\\d{2}$")
    is_int, is_dec, is_bool = F.contains("_k", F.lit("integer")), F.contains("_k", F.lit("decimal")) | F.contains("_k", F.lit("float")), F.contains("_k", F.lit("boolean"))
    o = F.when(date, F.col("_v")).when(is_int, F.coalesce(whole.cast("string"), "_v")).when(is_dec, F.coalesce(number.cast("string"), "_v")).when(is_bool, F.when(yes, "true").otherwise("false")).otherwise(F.col("_v"))
    typ = F.when(date & day, "xsd:date").when(date, "").when(is_int & whole.isNotNull(), "xsd:integer").when(~is_int & is_dec & number.isNotNull(), "xsd:decimal").when(~is_int & ~is_dec & is_bool, "xsd:boolean").otherwise("")
    out.append(row(v, inst("entity"), uri(v, "property", False), o, True, typ))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _short(uri: Column) -> Column:
    """prefix:name where the name is plain, else <uri>."""
    out = F.concat(F.lit("<"), uri, F.lit(">"))
    for prefix, ns in PREFIXES.items():
        rest = F.substr(uri, F.lit(len(ns) + 1))
        out = F.when(F.startswith(uri, F.lit(ns)) & rest.rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(f"{prefix}:"), rest)).otherwise(out)
    return out


def _quoted(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def to_turtle(triples: DataFrame) -> DataFrame:
    """(line) of each triple."""
    p = F.when(F.col("p") == RDF + "type", "a").otherwise(_short(F.col("p")))
    tag = F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit("@"), "lang")).when(F.coalesce("datatype", F.lit("")) != "", F.concat(F.lit("^^"), "datatype")).otherwise("")
    o = F.when(F.col("o_is_literal"), F.concat(_quoted(F.col("o")), tag)).otherwise(_short(F.col("o")))
    return triples.select(F.concat_ws(" ", _short(F.col("s")), p, o, F.lit(".")).alias("line"))


def turtle_header() -> list[str]:
    return [f"@prefix {p}: <{ns}> ." for p, ns in PREFIXES.items()]


def write_turtle(triples: DataFrame, path: str) -> None:
    """Part files, each with its own prefixes, so that every file is a document."""
    head = "\n".join(turtle_header())

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        first = True
        for pdf in batches:
            yield pd.DataFrame({"value": ([head] if first else []) + pdf["line"].tolist()})
            first = False

    to_turtle(triples).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def to_owl_xml(triples: DataFrame) -> DataFrame:
    """(subject, xml): an rdf:Description of each subject; a document is these within rdf:RDF."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf["s"].iloc[0]
        lines = []
        for p, o, lit, dt in zip(pdf["p"], pdf["o"], pdf["o_is_literal"], pdf["datatype"], strict=True):
            ns, _, name = p.rpartition("#")
            kind = f" rdf:datatype={quoteattr(XSD + dt[4:])}" if dt else ""
            lines.append(f'<n:{name} xmlns:n="{ns}#"{kind}>{escape(o)}</n:{name}>' if lit else f'<n:{name} xmlns:n="{ns}#" rdf:resource={quoteattr(o)}/>')
        return pd.DataFrame({"subject": [s], "xml": [f"<rdf:Description rdf:about={quoteattr(s)}>{''.join(sorted(lines))}</rdf:Description>"]})

    return triples.groupBy("s").applyInPandas(run, "subject string, xml string")


class MemorySink:
    """Turtle by graph name, in temporary views: for tests."""

    def __init__(self) -> None:
        self.graphs: dict[str, DataFrame] = {}

    def upload(self, triples: DataFrame, graph: str = "default", clear: bool = False) -> None:
        have = self.graphs.get(graph)
        self.graphs[graph] = triples if clear or have is None else have.unionByName(triples)


class SparqlSink:
    """SPARQL 1.1 graph store: partitions post their Turtle; the first request replaces the graph where ``clear`` is set."""

    def __init__(self, data_url: str, headers: dict[str, str] | None = None, timeout: float = 30) -> None:
        self.data_url, self.headers, self.timeout = data_url, dict(headers or {}), timeout

    def _send(self, method: str, graph: str | None, body: str) -> None:
        target = f"{self.data_url}?graph={urllib.request.quote(graph, safe='')}" if graph else f"{self.data_url}?default"
        req = urllib.request.Request(target, body.encode(), {"Content-Type": "text/turtle", **self.headers}, method=method)
        urllib.request.urlopen(req, timeout=self.timeout).close()

    def upload(self, triples: DataFrame, graph: str | None = None, clear: bool = False) -> None:
        head = "\n".join(turtle_header())
        if clear:
            self._send("PUT", graph, head)
        send = self._send

        def run(rows: Iterator) -> None:
            lines = [r["line"] for r in rows]
            for k in range(0, len(lines), 20_000):
                send("POST", graph, "\n".join([head, *lines[k : k + 20_000]]))

        to_turtle(triples).foreachPartition(run)


def fuseki(base_url: str, dataset: str, **options: object) -> SparqlSink:
    return SparqlSink(f"{base_url.rstrip('/')}/{dataset}/data", **options)


IS_A = ("instanceOf", "type", "rdf:type", "isA", "is_a", RDF + "type")
SUB = ("subClassOf", "rdfs:subClassOf", RDFS + "subClassOf")


def from_triples(triples: DataFrame) -> Graph:
    """Graph of plain (s, p, o): typings (the first of a subject), hierarchy, and relations."""
    from weftgraph.schemas import graph

    t = triples.select("s", "p", "o").withColumn("ord", F.monotonically_increasing_id())
    typed = t.filter(F.col("p").isin(*IS_A))
    up = t.filter(F.col("p").isin(*SUB))
    rel = t.filter(~F.col("p").isin(*IS_A, *SUB))
    first = typed.groupBy("s").agg(F.min_by("o", "ord").alias("class_name"), F.min("ord").alias("ord"))
    names = typed.select("o", "ord").unionByName(up.select("o", "ord")).unionByName(up.select(F.col("s").alias("o"), "ord"))
    classes = names.groupBy("o").agg(F.min("ord").alias("ord")).withColumnRenamed("o", "name")
    ends = rel.select(F.explode(F.array("s", "o")).alias("name"), "ord").groupBy("name").agg(F.min("ord").alias("ord"))
    known = first.select(F.col("s").alias("name")).unionByName(classes.select("name"))
    inst = first.select(F.col("s").alias("name"), "class_name", "ord").unionByName(ends.join(known, "name", "left_anti").select("name", F.lit("").alias("class_name"), "ord"))
    relations = rel.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(1.0).alias("weight"), "ord")
    return graph(triples.sparkSession, classes=classes, instances=inst, relations=relations, hierarchy=up.select(F.col("o").alias("parent"), F.col("s").alias("child"), "ord"))
