"""A query for each operator over the given tables, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import dictionary, scores
from weftgraph.functions import text as T
from weftgraph.functions import values as V
from weftgraph.operators import cluster, community, facts, govern, hierarchy, normalize, profile, quality, reads, star
from weftgraph.operators.retract import retract_chunks
from weftgraph.plans import fixtures
from weftgraph.plans.builder import STRUCTURAL, GraphBuilder
from weftgraph.schemas import Graph, graph, settled
from weftgraph.session import settle
from weftgraph.sources import documents, grids, rdf, store
from weftgraph.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])


# star build


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """region, nation, customer and supplier with declared keys; orders as edges of declared rows is another query."""
    t = lambda n: table(spark, sf_dir, n)
    fk = lambda c, to, k: {"from_column": c, "to_table": to, "to_column": k}
    items = [
        star.Table("region", t("region"), ["r_regionkey"], "r_regionkey", "r_name"),
        star.Table("nation", t("nation"), ["n_nationkey"], "n_nationkey", "n_name", [fk("n_regionkey", "region", "r_regionkey")]),
        star.Table("customer", t("customer"), ["c_custkey"], "c_custkey", "c_name", [fk("c_nationkey", "nation", "n_nationkey")]),
        star.Table("supplier", t("supplier"), ["s_suppkey"], "s_suppkey", "s_name", [fk("s_nationkey", "nation", "n_nationkey")]),
    ]
    return star.build(spark, items, skip_facts=False)


_ROWS = """
    rows_ as (select 'Region' as cls, r_name as name, 'region:' || r_regionkey as src from region
        union all select 'Nation', n_name, 'nation:' || n_nationkey from nation
        union all select 'Customer', c_name, 'customer:' || c_custkey from customer
        union all select 'Supplier', s_name, 'supplier:' || s_suppkey from supplier)"""
_EDGES = """
    edges_ as (select n_name as s, 'Nation_n_regionkey' as p, r_name as o, 'nation:' || n_nationkey as src from nation join region on n_regionkey = r_regionkey
        union all select c_name, 'Customer_c_nationkey', n_name, 'customer:' || c_custkey from customer join nation on c_nationkey = n_nationkey
        union all select s_name, 'Supplier_s_nationkey', n_name, 'supplier:' || s_suppkey from supplier join nation on s_nationkey = n_nationkey)"""


@query(f"with {_ROWS} select name, cls as class_name, src as source_chunk from rows_")
def star_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).instances.select("name", "class_name", F.get("source_chunks", F.lit(0)).alias("source_chunk"))


@query(f"with {_EDGES} select s as subject, p as predicate, o as object, src as source_chunk from edges_")
def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).relations.select("subject", "predicate", "object", F.get("source_chunks", F.lit(0)).alias("source_chunk"))


@query("""select c_name as entity, 'c_mktsegment' as property, c_mktsegment as value, 'xsd:string' as value_type from customer where trim(c_mktsegment) <> ''
    union all select c_name, 'c_acctbal', cast(c_acctbal as varchar), 'xsd:decimal' from customer where c_acctbal is not null union all select s_name, 's_acctbal', cast(s_acctbal as varchar), 'xsd:decimal' from supplier where s_acctbal is not null""")
def star_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).data_values.select("entity", "property", "value", "value_type")


@query("""select 'Nation_n_regionkey' as name, 'Nation' as domain, 'Region' as range union all select 'Customer_c_nationkey', 'Customer', 'Nation'
    union all select 'Supplier_s_nationkey', 'Supplier', 'Nation'""")
def star_object_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).object_props.select("name", "domain", "range")


@query("""select name, domain, range from (values ('r_regionkey', 'Region', 'xsd:integer'), ('r_name', 'Region', 'xsd:string'), ('n_nationkey', 'Nation', 'xsd:integer'), ('n_name', 'Nation', 'xsd:string'),
    ('c_custkey', 'Customer', 'xsd:integer'), ('c_name', 'Customer', 'xsd:string'), ('c_mktsegment', 'Customer', 'xsd:string'), ('c_acctbal', 'Customer', 'xsd:decimal'), ('s_suppkey', 'Supplier', 'xsd:integer'), ('s_name', 'Supplier', 'xsd:string'), ('s_acctbal', 'Supplier', 'xsd:decimal')) t(name, domain, range)""")
def star_data_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).data_props.select("name", "domain", "range")


def order_rows(spark: SparkSession, sf_dir: str) -> star.Table:
    """Declared rows: orders by key, whose customers are not loaded and become placeholders."""
    return star.Table("orders", table(spark, sf_dir, "orders"), ["o_orderkey"], "o_orderkey", "o_orderkey", [{"from_column": "o_custkey", "to_table": "customer", "to_column": "c_custkey"}], "shop:orders")


_IDENT = "'dbrow_' || sha256('[\"weft-row-v1\",\"shop:' || {t} || '\",\"' || {c} || '\",\"' || {v} || '\"]')"


@query(f"""select cast(o_orderkey as varchar) as name, 'Orders' as class_name, {_IDENT.format(t="'orders'", c="'o_orderkey'", v="o_orderkey")} as identity from orders
    union all select distinct 'customer_' || o_custkey, '', {_IDENT.format(t="'customer'", c="'c_custkey'", v="o_custkey")} from orders""")
def row_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build(spark, [order_rows(spark, sf_dir)], skip_facts=False).instances.select("name", "class_name", "identity")


@query("select cast(o_orderkey as varchar) as subject, 'Orders_o_custkey' as predicate, 'customer_' || o_custkey as object, 'shop:orders:' || o_orderkey as source_chunk from orders")
def row_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.build(spark, [order_rows(spark, sf_dir)], skip_facts=False).relations.select("subject", "predicate", "object", F.get("source_chunks", F.lit(0)).alias("source_chunk"))


@query("""with b as (select p_partkey, p_name as name, regexp_replace(trim(p_name), '[^A-Za-z0-9_.$@-]', '_', 'g') as u from part)
    select cast(p_partkey as bigint) as p_partkey, case when count(*) over (partition by regexp_replace(u, '_+', '_', 'g')) > 1 then name || '#' || p_partkey else name end as label from b""")
def instance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = star.Table("part", table(spark, sf_dir, "part"), ["p_partkey"], "p_partkey", "p_name")
    return star.instance_labels(star.text_rows(t), "p_name", "p_partkey", "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), F.col("_label").alias("label"))


# profiles


def aliased(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, list[str]]]:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"))
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"))
    return {"nation": (nation, ["nation_id"]), "region": (region, ["region_id"]), "customer": (customer, ["customer_id"])}


@query("""with c as (select n_regionkey as v from nation order by n_nationkey limit 30), r as (select r_regionkey as v from region order by 1 limit 30),
    cn as (select distinct c_nationkey as v from (select c_nationkey from customer order by c_custkey limit 30)), nn as (select distinct n_nationkey as v from (select n_nationkey from nation order by 1 limit 30))
    select 'nation' as from_table, 'region_id' as from_column, 'region' as to_table, 'region_id' as to_column where (select count(distinct c.v) from c join r on c.v = r.v) >= 0.3 * (select count(distinct v) from c)
    union all select 'customer', 'nation_id', 'nation', 'nation_id' where (select count(*) from cn join nn on cn.v = nn.v) >= 0.3 * (select count(*) from cn)""")
def fk_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.analyze(aliased(spark, sf_dir))["fks"]


@query("""with h as (select * from customer order by c_custkey limit 20)
    select 'customer' as "table", 'c_custkey' as "column", 'xsd:integer' as xsd_type union all select 'customer', 'c_name', 'xsd:string' union all select 'customer', 'c_nationkey', 'xsd:integer'
    union all select 'customer', 'c_acctbal', case when count(*) filter (regexp_full_match(cast(c_acctbal as varchar), '-?\\d+(\\.\\d+)?')) >= 0.7 * count(*) then 'xsd:decimal' else 'xsd:string' end from h
    union all select 'customer', 'c_mktsegment', 'xsd:string'""")
def column_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = profile.cells(table(spark, sf_dir, "customer"), ["c_custkey"], 30, "customer")
    return profile.column_types(head).select("table", "column", "xsd_type")


@query("select 'nation' as \"table\", 'nation_id' as \"column\" union all select 'region', 'region_id' union all select 'customer', 'customer_id'")
def pk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.analyze(aliased(spark, sf_dir))["keys"].select("table", "column")


@query("select 'region_name' as \"column\", trim(r_name) as value from region union all select 'region_id', cast(r_regionkey as varchar) from region")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order = aliased(spark, sf_dir)["region"]
    return profile.sample_values(profile.cells(df, order, 30, "region")).select("column", "value")


@query("""select 'supplier' as "table", 's_name' as "column" union all select 'customer', 'c_name'
    union all select 'part', 'p_name' where (select count(distinct p_name) >= 0.6 * count(*) from part)""")
def label_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = profile.cells(table(spark, sf_dir, "supplier"), [], None, "supplier").unionByName(profile.cells(table(spark, sf_dir, "customer"), [], None, "customer"))
    part = profile.cells(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [], None, "part")
    return profile.label_columns(cells.unionByName(part))


# scalars


@query(r"""select doc_id, list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), []) [1:50] as t, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as n from documents""".replace("list_concat(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), []) [1:50] as t", "sha256(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ')) as tokens"))
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(t, " "), 256).alias("tokens"), F.size(t).cast("bigint").alias("n"))


@query(r"""with u as (select distinct p_type as name from part union select distinct o_orderpriority from orders union select distinct '"' || p_name || '" (x)' from part)
    select name, case when trim(regexp_replace(regexp_replace(trim(name), '[\s<>"{}|^`\\()\[\],;:/?#%&*!+=~''·•«»‘’“”]', '_', 'g'), '_+', '_', 'g'), '_') = '' then 'Unknown'
    else trim(regexp_replace(regexp_replace(trim(name), '[\s<>"{}|^`\\()\[\],;:/?#%&*!+=~''·•«»‘’“”]', '_', 'g'), '_+', '_', 'g'), '_') end as uri from u""")
def safe_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).union(table(spark, sf_dir, "orders").select("o_orderpriority")).union(table(spark, sf_dir, "part").select(F.concat(F.lit('"'), "p_name", F.lit('" (x)'))))
    return names.distinct().select("name", T.safe_uri(F.col("name")).alias("uri"))


@query("""with e as (select distinct event_type as name from events union select distinct upper(event_type) || ' of_user' from events union select distinct '±' || event_type from events),
    p as (select name, list_filter(regexp_split_to_array(name, '[\\s_-]+'), lambda x: x <> '') as w, regexp_full_match(name, '[A-Za-z][A-Za-z0-9 _-]*') as ok from e)
    select name, case when ok then (case when w[1] = upper(w[1]) then lower(w[1]) else lower(w[1][1]) || w[1][2:] end)
        || array_to_string(list_transform(w[2:], lambda x: case when x = upper(x) and regexp_matches(x, '[A-Za-z]') then upper(x[1]) || lower(x[2:]) else upper(x[1]) || x[2:] end), '') else 'relatedTo' end as predicate,
        case when not ok then name end as label from p""")
def canon_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    names = e.union(e.select(F.concat(F.upper("name"), F.lit(" of_user")))).union(e.select(F.concat(F.lit("±"), "name")))
    pred, label = T.canon_predicate(F.col("name"))
    return names.distinct().select("name", pred.alias("predicate"), label.alias("label"))


@query(r"""with w as (select distinct unnest(string_split(text, ' ')) as s from documents where text is not null)
    select s, (trim(s) = '' or regexp_matches(trim(s), '^\d{4}[-./]\d{1,2}') or not regexp_matches(s, '\pL') or regexp_matches(trim(s), '^[+\-]?[\d,.]+\s*[^\d\s]{0,4}(\s+\S{1,3})?$')) as is_value,
    (trim(s) <> '' and (not regexp_matches(s, '\pL') or regexp_matches(trim(s), '^[\s(\[]*[+\-]?[\d,.]+\s*[^\d]{0,4}[)\]]*$'))) as is_value_like,
    (trim(s) <> '' and (regexp_matches(trim(s), '^[\d\-./\s,]+$') or length(trim(s)) < 2)) as is_value_label from w where not regexp_matches(s, '\s')""")
def value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("s")).distinct().filter(~F.col("s").rlike("\\s"))
    return w.select("s", V.is_value(F.col("s")).alias("is_value"), V.is_value_like(F.col("s")).alias("is_value_like"), V.is_value_label(F.col("s")).alias("is_value_label"))


@query("""select distinct d, true as is_date, strftime(o_orderdate, '%Y-%m-%d') as iso, 'xsd:' || case when d like '____-__-__' then 'date' when d like '________' then 'integer' when d like '____.%' and length(d) = 7 then 'decimal' else 'string' end as kind
    from (select o_orderdate, unnest([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y%m%d'), strftime(o_orderdate, '%Y.%m.%d'), strftime(o_orderdate, '%Y/%m/%d')]) as d from orders)""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda p: F.date_format("o_orderdate", p)
    d = table(spark, sf_dir, "orders").select(F.explode(F.array(f("yyyy-MM-dd"), f("yyyyMMdd"), f("yyyy.MM.dd"), f("yyyy/MM/dd"))).alias("d")).distinct()
    return d.select("d", V.looks_like_date(F.col("d")).alias("is_date"), V.normalize_date(F.col("d")).alias("iso"), V.auto_xsd_type(F.col("d")).alias("kind"))


@query("""with t as (select event_type, user_id, count(*) as s from events group by all),
    r as (select *, row_number() over (partition by event_type order by s desc) as k, sum(s) over (partition by event_type order by s desc rows unbounded preceding) as h,
        count(*) over (partition by event_type) as n, sum(s) over (partition by event_type) as tot, max(s) over (partition by event_type) as hi, min(s) over (partition by event_type) as lo from t),
    v as (select *, case when k < n then round(cast(k as double) * (n - k) * power(cast(h as double) / k - (cast(tot as double) - h) / (n - k), 2), 9) else -1.0 end as v from r)
    select event_type, case when any_value(hi) = any_value(lo) then any_value(n) else arg_min(k, struct_pack(a := -v, b := k)) end as k from v group by event_type""")
def natural_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("score"))
    return scores.natural_cut(t, "score", ["event_type"])


@query("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) as cosine
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    two = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.join(two, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(V.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


TERMS = [("the", "DEF-ART"), ("of", "PREP-OF"), ("die", "DEF-ART")]
_HAS = r"regexp_matches(text, '(?i)(^|[^\pL\pN_]){a}([^\pL\pN_]|$)') and not contains(lower(text), lower('{c}'))"


@query(f"""with f as (select doc_id, text, list_filter([case when {_HAS.format(a='the', c='DEF-ART')} then 'DEF-ART' end, case when {_HAS.format(a='of', c='PREP-OF')} then 'PREP-OF' end,
    case when {_HAS.format(a='die', c='DEF-ART')} and not ({_HAS.format(a='the', c='DEF-ART')}) then 'DEF-ART' end], lambda x: x is not null) as x from documents where text is not null)
    select doc_id, sha256(case when len(x) > 0 then text || ' ' || array_to_string(x, ' ') else text end) as expanded, len(x) as terms from f""")
def dictionary_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    out = dictionary.normalize_query(F.col("text"), TERMS)
    count = sum((F.endswith(out, F.lit(x)) | F.contains(F.substr(out, F.length("text") + 1), F.lit(x))).cast("int") for x in ("DEF-ART", "PREP-OF"))
    return d.select("doc_id", F.sha2(out, 256).alias("expanded"), F.when(out == F.col("text"), 0).otherwise(count).cast("bigint").alias("terms"))


# documents


@query("""select doc_id || '#0' as chunk_id, cast(doc_id as varchar) as doc, trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(10) || chr(9)) as chunk_text from documents
    where length(text) <= 1200 and trim(text, ' ' || chr(10) || chr(9)) <> ''""")
def chunk_short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that fit a chunk are one chunk: the part of chunk_documents that SQL can state."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") <= 1200).select(F.col("doc_id").cast("string").alias("doc"), "text")
    return documents.chunk_documents(d).select("chunk_id", "doc", "chunk_text")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return documents.chunk_documents(d)


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", documents.html_to_text(F.col("html")).alias("text"))


@query()
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("|"))).select("doc_id", F.posexplode(grids.pipe_table(F.col("text"))).alias("row", "cells"))
    return rows.select("doc_id", "row", F.to_json("cells").alias("cells"))


@query()
def row_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(grids.row_dump_udf(F.col("text"))).alias("row", "cells"))
    return rows.select("doc_id", "row", F.to_json("cells").alias("cells"))


@query()
def prose_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", grids.prose_only_udf(F.col("text")).alias("prose"))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc"), "text", F.col("doc_id").cast("int").alias("chunk_index"))


@query()
def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.chunk_facts(doc_chunks(spark, sf_dir))


@query()
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(facts.extract(doc_chunks(spark, sf_dir))["instances"].select("name", "class_name", "source_chunks"))


@query("""with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as name from documents), n as (select count(*) as n from documents)
    select name, count(*) as chunks from w group by name having count(*) <= 1 or count(*) / (select n from n) <= 0.3""")
def coverage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    words = d.select(F.col("doc_id").alias("chunk_id"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("name")).distinct()
    return facts.covered(words, d.count())


@query()
def mention_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents with mentions of benchmark-free common words as labels."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc"), "text")
    labels = d.select(F.col("id").alias("chunk_id"), F.array(*map(F.lit, ("the", "of", "die", "und", "de", "la"))).alias("labels"))
    return flat(facts.build_units(d, labels))


# merging


@query("""with n as (select distinct p_name as name from part union select distinct upper(p_name) || ' ' from part union select distinct replace(p_name, ' ', '-') from part),
    k as (select name, lower(regexp_replace(name, '[\\s_·•/\\\\()（）「」『』【】\\[\\]-]+', '', 'g')) as k from n), c as (select k, arg_min(name, struct_pack(a := length(name), b := name)) as canonical from k group by k)
    select name, canonical from k join c using (k) where name <> canonical""")
def instance_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    names = p.union(p.select(F.concat(F.upper("name"), F.lit(" ")))).union(p.select(F.replace("name", F.lit(" "), F.lit("-"))))
    return cluster.instance_renames(names)


@query("""with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id <> b.vec_id and list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.7),
    r(id, c) as (select a, a from e union select e.b, r.c from r join e on e.a = r.id), m as (select id, min(c) as comp from r group by id),
    k as (select comp, arg_min(id, struct_pack(a := length(cast(id as varchar)), b := id)) as canonical from m group by comp)
    select id as name, canonical from m join k using (comp) where id <> canonical""")
def cosine_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return cluster.cluster_by_cosine(e, 0.7)


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users and event types as relations, each event a chunk; some turned round, some as plain neighbours."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    kind = F.concat(F.lit("type "), F.col("event_type"))
    turned = F.col("event_id") % 10 == 0
    rel = e.select(
        F.when(turned, kind).otherwise(user).alias("subject"), F.when(F.col("event_id") % 3 == 0, "relatedTo").otherwise("did_event").alias("predicate"),
        F.when(turned, user).otherwise(kind).alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"),
        F.array(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("source_chunks"), F.col("event_id").alias("ord"),
    )
    none = F.array().cast("array<string>").alias("source_chunks")
    inst = e.select(user.alias("name")).distinct().select("name", F.lit("User").alias("class_name"), F.lit("").alias("identity"), none, F.xxhash64("name").alias("ord"))
    inst = inst.unionByName(e.select(kind.alias("name")).distinct().select("name", F.lit("EventType").alias("class_name"), F.lit("").alias("identity"), none, F.xxhash64("name").alias("ord")))
    classes = spark.createDataFrame([("User", "", None, "", [], 0), ("EventType", "", None, "", [], 1)], "name string, description string, parent string, source string, source_chunks array<string>, ord bigint")
    return graph(spark, relations=rel, instances=inst, classes=classes)


_EV = """ev as (select event_id, 'user ' || user_id as u, 'type ' || event_type as k, event_id % 10 = 0 as turned, case when event_id % 3 = 0 then 'relatedTo' else 'did_event' end as p from events)"""


@query(f"""with {_EV}, r as (select case when turned then k else u end as s, case when p = 'did_event' then 'didEvent' else p end as p, case when turned then u else k end as o, event_id from ev),
    m as (select s, p, o, cast(count(distinct event_id) as double) as weight from r group by all), named as (select distinct least(s, o) as a, greatest(s, o) as b from m where p = 'didEvent')
    select s as subject, p as predicate, o as object, weight from m where not (p = 'relatedTo' and exists (select 1 from named where a = least(s, o) and b = greatest(s, o)))""")
def relation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalize_graph over events: camelCase predicates, merged triples, weights, and named relations superseding relatedTo."""
    return normalize.normalize_graph(event_graph(spark, sf_dir)).relations.select("subject", "predicate", "object", "weight")


@query(f"""with {_EV}, r as (select least('User', 'EventType') as a, p, count(*) filter (turned) as f, count(*) filter (not turned) as v from ev group by p)
    select event_id, case when (f >= v) then k else u end as subject, case when (f >= v) then u else k end as object from ev join r using (p) where greatest(f, v) / (f + v) >= 0.75 and f + v >= 4
    union all select event_id, case when turned then k else u end, case when turned then u else k end from ev join r using (p) where not (greatest(f, v) / (f + v) >= 0.75 and f + v >= 4)""")
def direction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = event_graph(spark, sf_dir)
    return govern.vote_direction(g.relations, g.instances.select("name", "class_name")).select(F.col("ord").alias("event_id"), "subject", "object")


@query("""select event_id, event_type as predicate from events""")
def govern_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of event types, with separators and capitals, folded to the seeds."""
    e = table(spark, sf_dir, "events")
    messy = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat("event_type", F.lit("_")))
    rel = e.select(F.lit("s").alias("subject"), messy.alias("predicate"), F.lit("o").alias("object"), F.col("event_id").alias("ord"))
    seeds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(1000).collect()]
    props = spark.createDataFrame([], "name string, ord bigint")
    return govern.govern_predicates(rel, props, seeds).select(F.col("ord").alias("event_id"), "predicate")


@query("""select o_orderpriority as predicate, count(*) as n from orders group by 1 order by 2 desc, 1 limit 120""")
def known_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.known_predicates(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("predicate")))


@query(f"with {_ROWS}, {_EDGES} select (select count(distinct name) from rows_) as instances, 4 as classes, 3 as object_properties, 11 as data_properties, (select count(*) from edges_) as relations, 2 * (select count(*) from customer) + (select count(*) from supplier) as data_values, 0 as chunks")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.stats(settled(star_graph(spark, sf_dir)))


@query(f"""with {_ROWS}, {_EDGES} select 4 as class_count, (select count(distinct name) from rows_) as instance_count, 3 as relation_count, 0 as classes_without_instance, 0 as dangling, 0 as ungoverned, 0 as domain_violation,
    (select count(*) from edges_) as inst_relations, cast(100 as double) as completeness_pct, cast(100 as double) as grounding_pct, cast(100 as double) as quality_score""")
def quality_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["class_count", "instance_count", "relation_count", "classes_without_instance", "dangling", "ungoverned", "domain_violation", "inst_relations", "completeness_pct", "grounding_pct", "quality_score"]
    return quality.review_quality(settled(star_graph(spark, sf_dir))).select(*cols)


@query("""with g as (select c_custkey % 5 = 0 as gone, c_custkey, c_name from customer) select c_name as name from g where not gone union all select s_name from supplier union all select n_name from nation union all select r_name from region""")
def retract_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph without every fifth customer's row."""
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("chunk_id"))
    return retract_chunks(star_graph(spark, sf_dir), gone, STRUCTURAL).instances.select("name")


@query("""select s as subject, o as object from (select n_name as s, r_name as o from nation join region on n_regionkey = r_regionkey union all select s_name, n_name from supplier join nation on s_nationkey = n_nationkey
    union all select c_name, n_name from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 <> 0)""")
def retract_customer_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("chunk_id"))
    return retract_chunks(star_graph(spark, sf_dir), gone, STRUCTURAL).relations.select("subject", "object")


# hierarchy and graphs


@query("""select n_name as descendant, r_name as ancestor, 1 as depth from nation join region on n_regionkey = r_regionkey union all select r_name, 'World', 1 from region union all select n_name, 'World', 2 from nation""")
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(geo(spark, sf_dir))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.col("n_nationkey").cast("bigint").alias("ord"))
    return up.unionByName(r.select(F.lit("World").alias("parent"), F.col("r_name").alias("child"), (F.col("r_regionkey") + 1000).cast("bigint").alias("ord")))


@query("""select 'name' as name, n_name as domain from nation union all select 'name', r_name from region union all select 'name', 'World' union all select 'code', r_name from region union all select 'code', n_name from nation""")
def inheritance_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name is declared on World, code on each region: nations inherit both."""
    r = table(spark, sf_dir, "region")
    props = r.select(F.lit("code").alias("name"), F.col("r_name").alias("domain"), F.col("r_regionkey").cast("bigint").alias("ord")).unionByName(spark.createDataFrame([("name", "World", 99)], "name string, domain string, ord bigint"))
    return hierarchy.inherit_properties(graph(spark, hierarchy=geo(spark, sf_dir), data_props=props)).data_props.select("name", "domain")


@query("""select parent, child from (select r_name as parent, n_name as child from nation join region on n_regionkey = r_regionkey union all select 'World', r_name from region)""")
def clean_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With edges back from nations to World, which close circles and go, and to names that are no classes."""
    g = geo(spark, sf_dir)
    back = table(spark, sf_dir, "nation").select(F.col("n_name").alias("parent"), F.lit("World").alias("child"), (F.col("n_nationkey") + 5000).cast("bigint").alias("ord"))
    lost = table(spark, sf_dir, "region").select(F.lit("Nowhere").alias("parent"), F.col("r_name").alias("child"), F.lit(9000).cast("bigint").alias("ord"))
    names = g.select("parent").union(g.select("child")).distinct().select(F.col("parent").alias("name"), F.xxhash64("parent").alias("ord"))
    return hierarchy.clean_hierarchy(graph(spark, hierarchy=g.unionByName(back).unionByName(lost), classes=names)).hierarchy.select("parent", "child")


@query()
def head_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.element_at(F.split("p_name", " "), -1))).alias("name")).distinct()
    return hierarchy.head_noun_edges(names)


@query()
def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = settled(star_graph(spark, sf_dir))
    return flat(community.detect_communities(g))


@query()
def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    inst = p.select(F.col("p_name").alias("name"), F.lit("Part").alias("class_name")).union(p.select(F.initcap("p_name"), F.lit("Part")))
    return cluster.resolve_renames(inst, 0.9)


# stored graph and reads


def stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of the stored graph, as plans: a query that reads one alone makes that alone."""
    return store.graph_rows(settled(star_graph(spark, sf_dir)))


_URI = "'urn:weft:instance#' || replace({x}, ' ', '_')"


@query(f"""with {_ROWS} select replace(replace({_URI.format(x='name')}, '#', '@'), '@', '#') as uri, 'instance' as kind, name as label from rows_
    union all select 'urn:weft:domain#' || c, 'concept', c from (values ('Region'), ('Nation'), ('Customer'), ('Supplier')) t(c)
    union all select 'urn:weft:domain#' || d || '_' || p, 'property', p from (values ('Region', 'r_regionkey'), ('Region', 'r_name'), ('Nation', 'n_nationkey'), ('Nation', 'n_name'), ('Customer', 'c_custkey'), ('Customer', 'c_name'), ('Customer', 'c_mktsegment'), ('Customer', 'c_acctbal'), ('Supplier', 's_suppkey'), ('Supplier', 's_name'), ('Supplier', 's_acctbal')) t(d, p)""".replace("replace(replace('urn:weft:instance#' || replace(name, ' ', '_'), '#', '@'), '@', '#')", "'urn:weft:instance#' || replace(replace(name, ' ', '_'), '#', '_')"))
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)["labels"].select("uri", "kind", "label")


@query(f"""with {_ROWS}, {_EDGES} select 'objectProperty' as edge_kind, count(*) as n from (select distinct s, p, o from edges_) union all select 'instanceOf', count(distinct name) from rows_
    union all select 'objectProperty_schema', 3 union all select 'datatypeProperty_schema', 11""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)["edges"].groupBy("edge_kind").agg(F.count("*").alias("n"))


@query(f"with {_ROWS}, {_EDGES} select count(*) as n, count(distinct c) as chunks from (select name, src as c from rows_ union select s, src from edges_ union select o, src from edges_)")
def node_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir)["node_chunks"].agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))


@query(f"with {_EDGES} select count(*) as n from (select distinct s, p, o, src from edges_)")
def edge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.edge_source_rows(star_graph(spark, sf_dir)).agg(F.count("*").alias("n"))


@query("""with n as (select n_name as label from nation union all select r_name from region union all select c_name from customer union all select s_name from supplier
    union all select c from (values ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('r_regionkey'), ('r_name'), ('n_nationkey'), ('n_name'), ('c_custkey'), ('c_name'), ('c_mktsegment'), ('c_acctbal'), ('s_suppkey'), ('s_name'), ('s_acctbal')) t(c))
    select label, round((cast(contains(lower(label), 'customer') as int) + cast(contains(lower(label), '00001') as int)) / (1 + length(label) / 40), 6) as score from n
    where contains(lower(label), 'customer') or contains(lower(label), '00001') order by score desc, label limit 30""")
def search_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search_labels(stored(spark, sf_dir)["labels"], "customer 00001").select("label", "score")


@query("select n_name as label from nation order by 1 limit 1000")
def class_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return reads.class_instances(s["labels"], s["edges"], store.DOMAIN + "Nation").select("label")


@query("select count(*) as n from customer")
def count_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.count_class(stored(spark, sf_dir)["edges"], store.DOMAIN + "Customer")


@query(f"with {_EDGES}, d as (select x, count(*) as degree from (select distinct s, p, o from edges_) cross join lateral (select unnest([s, o]) as x) group by x) select x as label, degree from d order by degree desc, label limit 300")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return reads.entity_labels(s["labels"], s["edges"])


@query(f"with {_EDGES} select p as predicate, count(*) as n from (select distinct s, p, o from edges_) group by 1 order by 2 desc, 1 limit 120")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.predicates(stored(spark, sf_dir)["edges"])


@query(f"""with {_ROWS}, {_EDGES}, a as (select distinct s, p, o from edges_ union select distinct name, 'instanceOf', cls from rows_), st as (select r_name as x from region order by r_regionkey limit 1),
    one as (select a.* from a, st where s = x or o = x), f1 as (select s as x from one union select o from one), two as (select distinct a.* from a join f1 on a.s = f1.x or a.o = f1.x)
    select 1 as hop, s as subject, p as predicate, o as object from one union all select 2, s, p, o from two where (s, p, o) not in (select (s, p, o) from one) order by 1, 2, 3, 4 limit 5000""")
def neighbors_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = {k: settle(v, k) for k, v in stored(spark, sf_dir).items() if k in ("labels", "edges")}  # each is read several times
    name = table(spark, sf_dir, "region").orderBy("r_regionkey").first()["r_name"]
    start = reads.get_node(s["labels"].filter("kind = 'instance'"), name).first()["uri"]
    return reads.neighbors(s["labels"], s["edges"], start, 2, 5000)


@query(f"""with {_ROWS}, {_EDGES} select 'concept' as what, 4 as n union all select 'property', 11 union all select 'instance', count(distinct name) from rows_ union all select 'edges', (select count(*) from (select distinct s, p, o from edges_)) + (select count(distinct name) from rows_) + 14
    union all select 'chunks', count(distinct src) from rows_""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored(spark, sf_dir)
    return reads.counts(s["labels"], s["edges"], s["node_chunks"])


# exchange


@query(f"""with {_ROWS}, {_EDGES} select 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, 4 + 3 + 11 + 2 * (select count(*) from rows_) as n union all select 'http://www.w3.org/2000/01/rdf-schema#label', 4 + 3 + 11 + (select count(*) from rows_)
    union all select 'http://www.w3.org/2000/01/rdf-schema#comment', 4 union all select 'http://www.w3.org/2000/01/rdf-schema#domain', 14 union all select 'http://www.w3.org/2000/01/rdf-schema#range', 14
    union all select 'urn:weft:schema#sourceChunk', (select count(*) from rows_) union all select 'urn:weft:schema#c_mktsegment', (select count(*) from customer) union all select 'urn:weft:schema#c_acctbal', (select count(*) from customer) union all select 'urn:weft:schema#s_acctbal', (select count(*) from supplier)
    union all select 'urn:weft:schema#' || p, count(*) from (select distinct p, s, o from edges_) group by p""")
def rdf_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.to_rdf_triples(settled(star_graph(spark, sf_dir))).groupBy("p").agg(F.count("*").alias("n"))


@query()
def turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf.to_turtle(rdf.to_rdf_triples(settled(star_graph(spark, sf_dir))))


@query("""select 'entity:' || sha256('["weft","instance","' || n_name || '"]') as id, n_name as label, 'instance' as kind from nation union all select 'entity:' || sha256('["weft","class","Nation"]'), 'Nation', 'class'""")
def knowledge_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, g = nation_bundle(spark, sf_dir)
    from weftgraph.sources import knowledge

    return knowledge.export_knowledge(g, b, "s2").entities.select("id", "label", "kind")


@query("""select 'instanceOf' as predicate, n_name as subject, 'extracted' as assertion from nation""")
def knowledge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.sources import knowledge

    b, g = nation_bundle(spark, sf_dir)
    out = knowledge.export_knowledge(g, b, "s2")
    return out.facts.join(out.entities.select(F.col("id").alias("subject_id"), F.col("label").alias("subject")), "subject_id").select("predicate", "subject", "assertion")


def nation_bundle(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    from weftgraph.sources import knowledge

    n = table(spark, sf_dir, "nation")
    ident = F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))
    chunks = n.select(ident.alias("id"), F.lit("r1").alias("resource_id"), F.lit("1").alias("revision"), F.lit("x").alias("extraction_id"), F.col("n_name").alias("text"), F.col("n_nationkey").alias("ordinal"), F.lit("").alias("title"), F.lit("{}").alias("locator"), F.lit("{}").alias("extensions"))
    res = spark.createDataFrame([("r1", "1", "nation.csv", "file", None, "text/csv", "", "{}")], knowledge.RECORDS["resources"])
    g = star.build(spark, [star.Table("nation", n.select("n_nationkey", "n_name"), ["n_nationkey"], "n_nationkey", "n_name")], skip_facts=False)
    return knowledge.bundle(spark, "weft", "s1", resources=res, chunks=chunks), g


# sync and streams


@query("""select cast(c_custkey as varchar) as key, case when c_custkey % 7 = 0 then 'added' when c_custkey % 5 = 0 then 'changed' else 'unchanged' end as change from customer where c_custkey % 11 <> 0
    union all select cast(c_custkey as varchar), 'missing' from customer where c_custkey % 11 = 0 and c_custkey % 7 <> 0""")
def rows_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer against what was known of it: some rows unknown, some edited, some gone since."""
    c = table(spark, sf_dir, "customer")
    cols = c.columns
    before = c.filter("c_custkey % 7 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(" (old)"))).otherwise(F.col("c_name")))
    sig = sync.mapping_signature(cols, "c_custkey")
    known = before.select(F.col("c_custkey").cast("string").alias("key"), sync.fingerprint(sig, before, cols).alias("fingerprint"))
    return sync.diff_rows(c.filter("c_custkey % 11 <> 0"), cols, "c_custkey", known).select("key", "change")


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# whole builds


@query()
def build_star_postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GraphBuilder(spark).postprocess(star_graph(spark, sf_dir), coverage=False)
    return g.relations.select("subject", "predicate", "object", "weight")


@query()
def build_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc"), "text")
    g = GraphBuilder(spark).build(docs)
    return flat(g.instances.select("name", "class_name", "source_chunks"))


QUERIES |= fixtures.QUERIES
ORACLE_SQL |= fixtures.ORACLE_SQL
