"""Every registered query against the SQL that states its result, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftgraph.plans import queries

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", ["star_relations", "row_identities", "fk_discovery", "pk_candidates", "label_columns", "instance_labels", "doc_tokens", "value_tests", "dates", "natural_cut", "dictionary_expand", "chunk_short_documents", "coverage_filter", "instance_dedup", "direction_vote", "govern_predicates", "relation_merge", "quality_review", "retract_customers", "clean_hierarchy", "inheritance_closure", "graph_nodes", "entity_labels", "rows_diff", "events_hourly", "star_values", "graph_edges", "fixture_names", "fixture_name_columns", "fixture_grids", "fixture_facts", "fixture_extract", "fixture_units", "fixture_answers", "fixture_morphology", "fixture_merging", "fixture_models", "fixture_rdf"])
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ["html_text", "pipe_tables", "head_nouns", "chunk_documents"])
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1
