"""Queries over small stated inputs, for operators whose input the given tables have no shape of: names, tables in texts,
documents, enumerations, models' answers, stores, bundles, upkeep. Each gives rows (what, item, value); its SQL states them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import llm_json
from weftgraph.functions import text as T
from weftgraph.functions import values as V
from weftgraph.operators import cluster, facts, govern, hierarchy, normalize, profile, reads, relations, star
from weftgraph.plans.builder import GraphBuilder
from weftgraph.schemas import Graph, graph, settled
from weftgraph.session import settle, shared_dir
from weftgraph.sources import documents, grids, knowledge, rdf, store

Query = Callable[[SparkSession, str], DataFrame]
Row = tuple[str, str, str]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
LAYOUT = "what string, item string, value string"


def states(*expected: Row) -> Callable[[Query], Query]:
    """Registers a query with the rows that it gives."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sql = "select * from (values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in expected) + ") t(what, item, value)"

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def told(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple("" if v is None else str(v) for v in r) for r in rows], LAYOUT)


def compact(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def each(spark: SparkSession, cases: list[tuple[str, str]], functions: dict[str, Callable[[str], object]]) -> DataFrame:
    """(function, input, output as JSON) of row functions, run where the rows are."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            pdf["value"] = [compact(functions[w](i)) for w, i in zip(pdf["what"], pdf["item"], strict=True)]
            yield pdf

    return spark.createDataFrame([(w, i, "") for w, i in cases], LAYOUT).mapInPandas(run, LAYOUT)


def columns(spark: SparkSession, cases: list[tuple[str, str]], functions: dict[str, Callable]) -> DataFrame:
    """The same of column functions."""
    df = spark.createDataFrame([(w, i) for w, i in cases], "what string, item string")
    value = F.lit(None).cast("string")
    for name, f in functions.items():
        value = F.when(F.col("what") == name, f(F.col("item")).cast("string")).otherwise(value)
    return df.select("what", "item", value.alias("value"))


# A lexicon, longest words first, for an analyzer of fixtures.
LEXICON = {
    "생체시료": "NNG", "대체채널": "NNG", "금융기관": "NNG", "인터넷뱅킹": "NNG", "모바일": "NNG", "보험사": "NNG", "혈액": "NNG", "모근": "NNG", "은행": "NNG", "업무": "NNG", "오락": "NNG", "도박": "NNG",
    "관련": "NNG", "한국마사회": "NNP", "자본금": "NNG", "결과": "NNG", "보고": "NNG", "채취": "NNG", "제출": "NNG", "본사": "NNG", "등": "NNB", "의": "JKG", "를": "JKO", "에": "JKB", "은": "JX", "와": "JC", "한다": "EF",
    "하": "XSV", "이": "VCP", "다": "EF", "억": "NR", "원": "NNB", "500": "SN", ",": "SP", ".": "SF", "(": "SSO", ")": "SSC", "「": "SSO", "」": "SSC", "규제": "NNG",
}
RANKS = {"결과": 120, "보고": 900, "모근": 40_000}


def lexicon() -> T.Morphology:
    pattern = re.compile("|".join(map(re.escape, sorted(LEXICON, key=len, reverse=True))))
    return T.Morphology(lambda s: [T.Token(m[0], LEXICON[m[0]], m.start(), m.end(), RANKS.get(m[0])) for m in pattern.finditer(s)])


# names


NAMES = {
    "normalize_text": T.normalize_text, "strip_list_markers": T.strip_list_markers, "normalize_label": T.normalize_label, "is_name_shape": T.is_name_shape, "clean_name": T.clean_name,
    "strip_closers": T.strip_closers, "starts_with_list_marker": T.starts_with_list_marker, "name_core": T.name_core, "is_title": lambda s: bool(s) and grids.is_title(s), "is_value": grids.is_value, "looks_like_header": grids.looks_like_header,
}


@states(
    ("normalize_text", "구 분", '"구분"'), ("normalize_text", "N C S", '"NCS"'), ("normalize_text", "김 철수", '"김 철수"'), ("normalize_text", "A&amp;B", '"A&B"'), ("normalize_text", "“ｘ１”", '"x1"'),
    ("strip_list_markers", "01. 말산업 활성화", '"말산업 활성화"'), ("strip_list_markers", "(1) 경영주 (관리직)", '"경영주 (관리직)"'), ("strip_list_markers", "*수료증번호", '"수료증번호"'), ("strip_list_markers", "경영지표(1)", '"경영지표"'),
    ("strip_list_markers", "내.외부", '"내.외부"'), ("strip_list_markers", "일.숙직비", '"일.숙직비"'), ("strip_list_markers", "(주)마장", '"(주)마장"'), ("strip_list_markers", "ㅇ 사업비", '"사업비"'), ("strip_list_markers", "12-2. 위탁", '"위탁"'), ("strip_list_markers", "3.14", '"3.14"'),
    ("normalize_label", "② 「예 산」", '"예산"'), ("is_name_shape", "AA, ", "false"), ("is_name_shape", "한국마사회", "true"), ("is_name_shape", "끝났다.", "false"), ("is_name_shape", "(가", "false"),
    ("clean_name", "가. 노동생산성", '"노동생산성"'), ("clean_name", "끝났다.", "null"), ("strip_closers", "끝났다.) ;", '"끝났다."'), ("starts_with_list_marker", "- 항목", "true"), ("starts_with_list_marker", "항목", "false"),
    ("name_core", "NA162000.23 제주목장사업", '"제주목장사업"'), ("name_core", "경영주 (관리직)", '"경영주"'), ("name_core", "감사 - 회계 처리의 적정성을 검토하는 절차", '"감사"'), ("name_core", "A1", '"A1"'),
    ("is_title", "여신 전결권 한도", "true"), ("is_title", "12", "false"), ("is_value", "3 이하", "true"), ("is_value", "'18년", "true"), ("is_value", "5,000만원 이하 임차인", "false"), ("looks_like_header", "□ 예산 집행지침", "false"), ("looks_like_header", "금액", "true"),
)
def fixture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, [r[:2] for r in FIXTURE_NAMES_CASES], NAMES)


@states(
    ("normalize_name", " 'Acme,  Inc.' ", "Acme, Inc"), ("is_class_name", "여신심사위원회", "true"), ("is_class_name", "29", "false"), ("is_class_name", "S", "false"), ("is_class_name", "one two three four five six seven", "false"),
    ("is_entity_shape", "Ghost", "true"), ("is_entity_shape", "12%", "false"), ("is_entity_shape", "", "false"), ("clean_value", "1,200만 (추정)", "1,200만"), ("clean_value", "plain (x)", "plain (x)"),
    ("english_local_name", "담당 부서", "departmentInCharge"), ("english_local_name", "예산", "예산"), ("strip_argument_noun", "colorOf", "colorOf"), ("strip_argument_noun", "마사회운영", "운영"), ("schema_max_items", "4096", "60"), ("schema_max_items", "100", "8"),
)
def fixture_name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    translated = F.create_map(F.lit("담당 부서"), F.lit("department in charge"))
    functions = {
        "normalize_name": T.normalize_name, "is_class_name": V.is_class_name, "is_entity_shape": V.is_entity_shape, "clean_value": V.clean_value,
        "english_local_name": lambda c: T.english_local_name(c, F.try_element_at(translated, c), False), "strip_argument_noun": lambda c: T.strip_argument_noun(c, F.lit("마사회"), F.lit("red")),
        "schema_max_items": lambda c: F.when(c == "100", V.schema_max_items(100)).otherwise(V.schema_max_items(4096)),
    }
    return columns(spark, [r[:2] for r in _expected("fixture_name_columns")], functions)


def _expected(name: str) -> list[Row]:
    """The rows that a query's SQL states."""
    return [tuple(x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", r)) for r in re.findall(r"\(((?:'(?:[^']|'')*'(?:, )?){3})\)", ORACLE_SQL[name])]


FIXTURE_NAMES_CASES = _expected("fixture_names")


# tables in texts


SPANS = "<table><tr><td rowspan='2'>A</td><td>x</td></tr><tr><td>y</td></tr></table>"
PIPES = "| 구분 | 금액 |\n|---|---|\n| 인건비 | 1억 |\n| 경비 | 2억 |\n본문 문장이다."
DUMP = "부서 담당자 예산 기준일\n여신심사부 김철수 1200 2026-01-01\n담보평가부 이영희 800 2026-01-01\n리스크관리부 박민수 1500 2026-01-01\n준법감시실 최지훈 600 2026-01-01"
RECORD = '{\n"name": "Alpha Corp",\n"n": 3,\n"city": "Berlin"}'
UNITS = "여신 한도\n(단위 : 억원)\n<table><tr><td>항목</td><td>전년</td><td>당년</td></tr><tr><td></td><td>억원</td><td>억원</td></tr><tr><td>매출액</td><td>120</td><td>150</td></tr><tr><td>영업이익</td><td>12</td><td>18</td></tr><tr><td>순이익</td><td>9</td><td>14</td></tr></table>"
BUDGET = "<table><tr><td>기관명</td><td>담당부서</td><td>예산</td></tr><tr><td>한국마사회</td><td>말산업연구소</td><td>12억원</td></tr><tr><td>농림축산식품부</td><td>축산정책과</td><td>30억원</td></tr><tr><td>제주특별자치도</td><td>축산과</td><td>5억원</td></tr></table>"
CARRIED = "<table><tr><td>렛츠런재단</td><td>사업팀</td><td>3억원</td></tr><tr><td>제주본부</td><td>말산업팀</td><td>2억원</td></tr></table>"
YEARS = "<table><tr><td>연도</td><td>매출</td></tr><tr><td>2019</td><td>1,000억원</td></tr><tr><td>2020</td><td>1,200억원</td></tr><tr><td>2021</td><td>1,500억원</td></tr></table>"
GRIDS = {
    "table_cell_rows": grids.table_cell_rows, "parse_html_table": grids.parse_html_table, "html_rows": grids.html_rows, "delimited_rows": grids.delimited_rows, "parse_pipe_table": grids.parse_pipe_table, "parse_row_dump": grids.parse_row_dump,
    "record_text": grids.record_text, "table_caption": grids.table_caption, "prose_only": grids.prose_only, "classify_columns": lambda t: grids.classify_columns(grids.parse_html_table(t)), "pipe_caption": grids.pipe_caption,
    "detect_header": lambda t: grids.detect_header(rows := grids.parse_html_table(t), grids.classify_columns(rows)), "merge_header_rows": lambda t: grids.merge_header_rows(rows := grids.parse_html_table(t), grids.classify_columns(rows), 0), "unit_row": lambda t: grids.unit_row(grids.parse_html_table(t), 1),
}


@states(
    ("parse_html_table", SPANS, '[["A","x"],["A","y"]]'), ("html_rows", SPANS, '[["A","x"],["","y"]]'), ("table_cell_rows", SPANS, '[["A","x"],["","y"]]'), ("table_cell_rows", "a\tb\n1\t2", '[["a","b"],["1","2"]]'), ("delimited_rows", 'id,name\n1,"a,b"', '[["id","name"],["1","a,b"]]'),
    ("parse_pipe_table", PIPES, '[["구분","금액"],["인건비","1억"],["경비","2억"]]'), ("parse_pipe_table", "a | b", "[]"), ("parse_row_dump", DUMP, '[["부서","담당자","예산","기준일"],["여신심사부","김철수","1200","2026-01-01"],["담보평가부","이영희","800","2026-01-01"],["리스크관리부","박민수","1500","2026-01-01"],["준법감시실","최지훈","600","2026-01-01"]]'),
    ("parse_row_dump", "This is a line of prose.\nHere is another line too.\nAnd a third line here.\nAnd the fourth line here.", "[]"), ("record_text", RECORD, '"Alpha Corp\\nBerlin"'), ("record_text", "plain text", "null"), ("table_caption", UNITS, '"여신 한도"'), ("pipe_caption", "# 예산\n| a | b |", '"예산"'),
    ("prose_only", DUMP, '""'), ("prose_only", PIPES, '"본문 문장이다."'), ("prose_only", "앞 <table><tr><td>x</td></tr></table>뒤", '"앞  뒤"'), ("classify_columns", UNITS, '["entity","value","value"]'), ("detect_header", UNITS, "0"), ("detect_header", CARRIED, "null"), ("merge_header_rows", UNITS, '[["항목","전년 억원","당년 억원"],2]'), ("unit_row", UNITS, "true"),
)
def fixture_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(spark, [r[:2] for r in _expected("fixture_grids")], GRIDS)


def chunk_frame(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(f"{d}#{i}", d, t, i) for d, ts in texts.items() for i, t in enumerate(ts)], "id string, doc string, text string, chunk_index int")


@states(
    ("a#0", "ent", "한국마사회 | 기관명"), ("a#0", "ent", "농림축산식품부 | 기관명"), ("a#0", "ent", "제주특별자치도 | 기관명"), ("a#0", "ent", "말산업연구소 | 담당부서"), ("a#0", "ent", "축산정책과 | 담당부서"), ("a#0", "ent", "축산과 | 담당부서"),
    ("a#0", "rel", "한국마사회 | 담당부서 | 말산업연구소"), ("a#0", "rel", "농림축산식품부 | 담당부서 | 축산정책과"), ("a#0", "rel", "제주특별자치도 | 담당부서 | 축산과"), ("a#0", "prop", "한국마사회 | 예산 | 12억원"), ("a#0", "prop", "농림축산식품부 | 예산 | 30억원"), ("a#0", "prop", "제주특별자치도 | 예산 | 5억원"),
    ("a#0", "pair", "말산업연구소 | 한국마사회"), ("a#0", "pair", "농림축산식품부 | 축산정책과"), ("a#0", "pair", "제주특별자치도 | 축산과"), ("a#1", "ent", "렛츠런재단 | 기관명"), ("a#1", "ent", "제주본부 | 기관명"), ("a#1", "ent", "사업팀 | 담당부서"), ("a#1", "ent", "말산업팀 | 담당부서"),
    ("a#1", "rel", "렛츠런재단 | 담당부서 | 사업팀"), ("a#1", "rel", "제주본부 | 담당부서 | 말산업팀"), ("a#1", "prop", "렛츠런재단 | 예산 | 3억원"), ("a#1", "prop", "제주본부 | 예산 | 2억원"), ("a#1", "pair", "렛츠런재단 | 사업팀"), ("a#1", "pair", "말산업팀 | 제주본부"),
    ("b#0", "ent", "연도 2019 | 연도"), ("b#0", "ent", "연도 2020 | 연도"), ("b#0", "ent", "연도 2021 | 연도"), ("b#0", "prop", "연도 2019 | 매출 | 1,000억원"), ("b#0", "prop", "연도 2020 | 매출 | 1,200억원"), ("b#0", "prop", "연도 2021 | 매출 | 1,500억원"),
    ("c#0", "ent", "매출액 | 항목"), ("c#0", "ent", "영업이익 | 항목"), ("c#0", "ent", "순이익 | 항목"), ("c#0", "prop", "매출액 | 전년 억원 | 120"), ("c#0", "prop", "영업이익 | 전년 억원 | 12"), ("c#0", "prop", "순이익 | 전년 억원 | 9"), ("c#0", "prop", "매출액 | 당년 억원 | 150"), ("c#0", "prop", "영업이익 | 당년 억원 | 18"), ("c#0", "prop", "순이익 | 당년 억원 | 14"),
    ("d#0", "ent", "한국마사회 | "), ("d#0", "ent", "자본금 | "), ("d#0", "prop", "한국마사회 | 자본금 | 500억원"),
)
def fixture_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of tables (a header that carries over, rows that only values name, a row of units) and of prose under an analyzer."""
    chunks = chunk_frame(spark, {"a": [BUDGET, CARRIED], "b": [YEARS], "c": [UNITS.replace("여신 한도\n(단위 : 억원)\n", "")], "d": ["한국마사회의 자본금은 500억원이다."]})
    return facts.chunk_facts(chunks, lexicon).select(F.col("chunk_id").alias("what"), F.col("kind").alias("item"), F.concat_ws(" | ", "a", "b", "c").alias("value")).distinct()


@states(
    ("instance", "공통비", "항목"), ("instance", "기타", "항목"), ("instance", "예비비", "항목"), ("relation", "렛츠런재단 > 사업팀", "relatedTo / 담당부서"), ("relation", "제주본부 > 말산업팀", "relatedTo / 담당부서"),
    ("relation", "한국마사회 > 말산업연구소", "relatedTo / 담당부서"), ("relation", "농림축산식품부 > 축산정책과", "relatedTo / 담당부서"), ("relation", "제주특별자치도 > 축산과", "relatedTo / 담당부서"), ("property", "예산", ""), ("dropped in 25 chunks", "0", ""),
)
def fixture_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rules: a name in 25 of 25 chunks says nothing, in 5 it does; column names label relations and declare properties."""
    row = "<table><tr><td>항목</td><td>금액</td></tr><tr><td>공통비</td><td>1억원</td></tr><tr><td>기타</td><td>2억원</td></tr><tr><td>예비비</td><td>3억원</td></tr></table>"
    few, many = facts.extract(chunk_frame(spark, {"a": [row] * 5})), facts.extract(chunk_frame(spark, {"a": [row] * 25}))
    doc = facts.extract(chunk_frame(spark, {"a": [BUDGET, CARRIED]}))
    out = few["instances"].select(F.lit("instance").alias("what"), F.col("name").alias("item"), F.col("class_name").alias("value"))
    out = out.unionByName(doc["relations"].select(F.lit("relation").alias("what"), F.concat_ws(" > ", "subject", "object").alias("item"), F.concat_ws(" / ", "predicate", "label").alias("value")))
    out = out.unionByName(doc["data_props"].select(F.lit("property").alias("what"), F.col("name").alias("item"), F.col("domain").alias("value")))
    return out.unionByName(many["instances"].agg(F.lit("dropped in 25 chunks").alias("what"), F.count("*").cast("string").alias("item"), F.lit("").alias("value")))


@states(
    ("split_units", "0", "인건비 | 1억 / row"), ("split_units", "1", "경비 | 2억 / row"), ("split_units", "2", "본문 문장이다. / text"), ("find_mentions", "Alpha Corp|Beta", "Alpha Corp@0:10,Beta@20:24"), ("find_mentions", "Corp|12", ""), ("find_mentions", "Al pha", "Al pha@0:5"),
    ("build_units", "u#0", "Alpha Corp acquired Beta. > Alpha Corp,Beta"), ("relation_label", "인건비", "금액"), ("labels_by_chunk", "u#0", "Alpha Corp,Beta,Gamma"),
)
def fixture_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, mentions (longest first, white space apart, not within numbers) and labels."""
    rows: list[tuple] = [("split_units", i, f"{t} / {'row' if is_row else 'text'}") for i, (t, is_row, _) in enumerate(facts.split_units(PIPES))]
    show = lambda found: ",".join(f"{m}@{a}:{z}" for m, a, z in found)
    text = "Alpha Corp acquired Beta in 2023."
    rows += [("find_mentions", "Alpha Corp|Beta", show(facts.find_mentions(text, ["Beta", "Alpha Corp"]))), ("find_mentions", "Corp|12", show(facts.find_mentions("Corporate 3125", ["12"], None))), ("find_mentions", "Al pha", show(facts.find_mentions(text, ["Al pha"])))]
    chunks = chunk_frame(spark, {"u": ["Alpha Corp acquired Beta. Gamma slept."]})
    none = "name string, source_chunks array<string>"
    labels = facts.labels_by_chunk(spark.createDataFrame([("Gamma", ["u#0"])], none), spark.createDataFrame([("Alpha Corp", ["u#0"]), ("Beta", ["u#0"])], none))
    units = facts.build_units(chunks, labels)
    out = told(spark, rows).unionByName(units.select(F.lit("build_units").alias("what"), F.col("chunk_id").alias("item"), F.concat(F.col("text"), F.lit(" > "), F.array_join("mentions", ",")).alias("value")))
    heads = spark.createDataFrame([({"인건비": "구분", "1억": "금액"},)], "h map<string,string>")
    out = out.unionByName(heads.select(F.lit("relation_label").alias("what"), F.lit("인건비").alias("item"), facts.relation_label(F.col("h"), F.lit("인건비"), F.lit("1억")).alias("value")))
    return out.unionByName(labels.select(F.lit("labels_by_chunk").alias("what"), F.col("chunk_id").alias("item"), F.array_join("labels", ",").alias("value")))


# documents


@states(
    ("extract_text", "a.html", "Title\nBody"), ("extract_text", "a.txt", "plain"), ("html_to_text", "p", "x & y"), ("load_documents", "x.txt", "one"), ("load_documents", "y.html", "two"), ("chunk_text", "0", "a. b."), ("chunk_text", "1", "b.\nc. d."), ("chunk_documents", "n.txt#0", "short"), ("normalize_documents", "t.csv#0", "id,name"),
    ("coerce_chunks", "k#0", "first"), ("coerce_chunks", "own", "second"), ("strip_headers", "HEAD: body", "body"), ("split_sheets", "w.xlsx#sheet=dept", "0"), ("split_sheets", "w.xlsx#sheet=emp", "1"), ("rows_to_csv", "", '1,"a,b"'), ("rows_to_csv", "", "2,c"), ("tables_of", "dept", "id,name|1,A"), ("tables_of", "emp", "id,name|7,B"),
)
def fixture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = "<h1>Title</h1><script>no()</script><p>Body</p>"
    files = spark.createDataFrame([("a.html", bytearray(html.encode())), ("a.txt", bytearray(b"plain"))], "name string, content binary")
    out = files.select(F.lit("extract_text").alias("what"), F.col("name").alias("item"), documents.extract_text(F.col("name"), F.col("content")).alias("value"))
    out = out.unionByName(spark.createDataFrame([("p", "<p>x &amp; y</p>")], "i string, h string").select(F.lit("html_to_text").alias("what"), F.col("i").alias("item"), documents.html_to_text(F.col("h")).alias("value")))
    home = f"{shared_dir(spark)}/weft-fixture-documents"
    write = lambda name, text: spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/{name}")
    write("x.txt", "one")
    write("y.html", "<p>two</p>")
    loaded = documents.load_documents(spark, [f"{home}/x.txt/part-*", f"{home}/y.html/part-*"])
    # part files have names of their own: what counts is the text under its folder's kind
    texts = loaded.select(F.lit("load_documents").alias("what"), F.when(F.contains("text", F.lit("one")), "x.txt").otherwise("y.html").alias("item"), F.regexp_replace(F.trim(F.regexp_replace("text", "</?p>|\\s+$", "")), "\n", "").alias("value"))
    out = out.unionByName(texts)
    out = out.unionByName(told(spark, [("chunk_text", i, t) for i, t in enumerate(documents.py_chunk_text("a. b.\n\nc. d.", 8, 3))]))
    d = spark.createDataFrame([("n.txt", "short")], "doc string, text string")
    out = out.unionByName(documents.chunk_documents(d).select(F.lit("chunk_documents").alias("what"), F.col("chunk_id").alias("item"), F.col("chunk_text").alias("value")))
    t = spark.createDataFrame([("t.csv", "id,name")], "doc string, text string")
    out = out.unionByName(documents.normalize_documents(t, True).select(F.lit("normalize_documents").alias("what"), F.col("id").alias("item"), F.col("text").alias("value")))
    c = spark.createDataFrame([("k", None, "first", 0), ("k", "own", "second", 1)], "doc string, chunk_id string, chunk_text string, chunk_index int")
    out = out.unionByName(documents.normalize_documents(c).select(F.lit("coerce_chunks").alias("what"), F.col("id").alias("item"), F.col("text").alias("value")))
    out = out.unionByName(spark.createDataFrame([("HEAD: body",)], "s string").select(F.lit("strip_headers").alias("what"), F.col("s").alias("item"), documents.strip_headers(F.col("s"), ["^HEAD: "]).alias("value")))
    sheets = chunk_frame(spark, {"w.xlsx": ["[Sheet: dept]\nid,name\n1,A", "[Sheet: emp]\nid,name\n7,B"]})
    out = out.unionByName(documents.split_sheets(sheets).select(F.lit("split_sheets").alias("what"), F.col("table").alias("item"), F.col("chunk_index").cast("string").alias("value")))
    rows = spark.createDataFrame([(1, "a,b"), (2, "c")], "id int, name string")
    out = out.unionByName(documents.rows_to_csv(rows).select(F.lit("rows_to_csv").alias("what"), F.lit("").alias("item"), F.col("line").alias("value")))
    bare = sheets.withColumn("text", F.regexp_replace("text", "^\\[Sheet: (\\w+)\\]\n", "[Sheet: $1]\n"))
    tables = GraphBuilder(spark).tables_of(bare)
    for name, df in sorted(tables.items()):
        own = [x for x in df.columns if not x.startswith("_")]
        body = df.orderBy("_row").select(F.concat_ws(",", *own).alias("l")).agg(F.array_join(F.collect_list("l"), "|").alias("b"))
        out = out.unionByName(body.select(F.lit("tables_of").alias("what"), F.lit(name).alias("item"), F.concat(F.lit(",".join(own) + "|"), "b").alias("value")))
    return out


# hierarchy and names


HEARST = "혈액, 모근 등의 생체시료를 채취한다. 모바일, 인터넷뱅킹 등 대체채널에 제출한다."


@states(
    ("hearst", "생체시료", "혈액"), ("hearst", "생체시료", "모근"), ("hearst", "대체채널", "모바일"), ("hearst", "대체채널", "인터넷뱅킹"), ("hearst", "금융기관", "은행"), ("hearst", "금융기관", "보험사"), ("hierarchy", "생체시료", "혈액"), ("hierarchy", "생체시료", "모근"), ("hierarchy", "대체채널", "모바일"), ("hierarchy", "대체채널", "인터넷뱅킹"),
    ("hierarchy", "금융기관", "은행"), ("hierarchy", "금융기관", "보험사"), ("is_sentence_like", "본사에 보고한다", "true"), ("is_sentence_like", "자본금", "false"), ("is_common_word", "결과", "true"), ("is_common_word", "모근", "false"), ("is_common_word", "결과 보고", "false"), ("shorten_entity_name", "본사에 보고한다", "본사"), ("shorten_entity_name", "자본금", "자본금"),
    ("noun_phrases", "한국마사회의 자본금", "한국마사회,자본금"), ("prose_values", "", "한국마사회 / 자본금 / 500억원"), ("prune_common_words", "", "결과"),
)
def fixture_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an analyzer gives: enumerations (not in brackets, nor "related to"), names, values, common words."""
    filler = [f"다음 회의 {i}" for i in range(20)]
    texts = chunk_frame(spark, {"h": [HEARST, "은행, 보험사 등 금융기관에 제출한다.", "오락, 도박 등 업무와 관련이", "「은행, 도박 등 규제」", *filler]})
    pairs = hierarchy.extract_hearst_pairs(texts, lexicon)
    out = pairs.select(F.lit("hearst").alias("what"), F.col("hypernym").alias("item"), F.col("hyponym").alias("value"))
    out = out.unionByName(hierarchy.hearst_hierarchy(pairs, texts).select(F.lit("hierarchy").alias("what"), F.col("parent").alias("item"), F.col("child").alias("value")))
    m, low = lexicon(), lambda b: str(b).lower()
    rows = [("is_sentence_like", s, low(m.sentence_like(s))) for s in ("본사에 보고한다", "자본금")] + [("is_common_word", s, low(m.common(s))) for s in ("결과", "모근", "결과 보고")]
    rows += [("shorten_entity_name", s, m.shortened(s)) for s in ("본사에 보고한다", "자본금")] + [("noun_phrases", "한국마사회의 자본금", ",".join(m.nouns("한국마사회의 자본금")))]
    rows += [("prose_values", "", " / ".join(v)) for v in m.values("한국마사회의 자본금은 500억원이다.")]
    names = spark.createDataFrame([("결과",), ("모근",), ("보고",)], "name string")
    common = hierarchy.common_words(names, spark.createDataFrame([("보고",)], "name string"), lexicon)
    return out.unionByName(told(spark, rows)).unionByName(common.select(F.lit("prune_common_words").alias("what"), F.lit("").alias("item"), F.col("name").alias("value")))


INST, REL = "name string, class_name string, identity string, source_chunks array<string>, ord bigint", "subject string, predicate string, object string, label string, source_chunks array<string>, ord bigint"


def small_graph(spark: SparkSession, instances: list[tuple] = (), relations_: list[tuple] = (), values: list[tuple] = (), **more: DataFrame) -> Graph:
    """instances (name, class, chunks), relations (s, p, o, chunks), values (e, p, v, chunks)."""
    inst = spark.createDataFrame([(n, c, "", ch, i) for i, (n, c, ch) in enumerate(instances)], INST)
    rel = spark.createDataFrame([(s, p, o, None, ch, i) for i, (s, p, o, ch) in enumerate(relations_)], REL).withColumn("predicate_type", F.lit("ObjectProperty")).withColumn("weight", F.lit(1.0))
    val = spark.createDataFrame([(e, p, v, "xsd:string", ch, i) for i, (e, p, v, ch) in enumerate(values)], "entity string, property string, value string, value_type string, source_chunks array<string>, ord bigint")
    return graph(spark, instances=inst, relations=rel, data_values=val, **more)


def names_of(g: Graph, what: str) -> DataFrame:
    return g.instances.select(F.lit(what).alias("what"), F.col("name").alias("item"), F.coalesce("class_name", F.lit("")).alias("value"))


@states(
    ("self typed", "x", "P"), ("self typed", "y", ""), ("folded", "경마공원본부", ""), ("folded", "경마", ""), ("coverage", "kept", ""), ("reconciled", "New name", "T"), ("merged classes", "A", "first"), ("merged classes", "B", "second"),
)
def fixture_graph_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances typed by their own names, fragments of names (not words of them), wide names, identities, merges."""
    up = spark.createDataFrame([("P", "x", 0)], "parent string, child string, ord bigint")
    out = names_of(hierarchy.fix_self_typed(small_graph(spark, [("x", "x", []), ("y", "y", [])], hierarchy=up)), "self typed")
    frag = small_graph(spark, [("경마공원본부", "", ["c1", "c2"]), ("경마공원", "", ["c1"]), ("경마", "", ["c9"])])
    out = out.unionByName(names_of(hierarchy.fold_fragments(frag), "folded"))
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(20)], "id string")
    from weftgraph.plans.builder import apply_coverage

    wide = small_graph(spark, [("wide", "", [f"c{i}" for i in range(8)]), ("kept", "", ["c1", "c2"])], chunks=chunks)
    out = out.unionByName(names_of(apply_coverage(wide), "coverage"))
    rows = spark.createDataFrame([("T_1", "", "id1", [], 0), ("New name", "T", "id1", ["r1"], 1)], INST)
    out = out.unionByName(names_of(normalize.reconcile_identities(graph(spark, instances=rows)), "reconciled"))
    cls = lambda name, text: spark.createDataFrame([(name, text, 0)], "name string, description string, ord bigint")
    both = normalize.merge(graph(spark, classes=cls("A", "first")), graph(spark, classes=cls("A", "again").unionByName(cls("B", "second"))))
    return out.unionByName(both.classes.select(F.lit("merged classes").alias("what"), F.col("name").alias("item"), F.col("description").alias("value")))


@states(
    ("normalized", "instances", "Alice,Bob,Carol"), ("normalized", "types", "Alice:Person,Bob:Person,Carol:"), ("normalized", "relations", "Alice knows Bob 2.0"), ("normalized", "values", "Alice age 30"), ("normalized", "hierarchy", "Agent>Person"),
    ("quality", "dangling", "1"), ("quality", "classes_without_instance", "1"), ("quality", "ungoverned", "1"), ("quality", "untyped", "0"), ("quality", "completeness_pct", "50.0"), ("quality", "domain_violation", "0"),
)
def fixture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loading rules on a graph with every kind of disorder, and a quality report that has something to tell."""
    rel = [("Alice", "type", "Person", ["c1"]), ("Person", "subClassOf", "Agent", []), ("Alice", "knows", "Bob", ["c1"]), ("01. Alice", "knows", "Bob", ["c2"]), ("Alice", "relatedTo", "Bob", ["c3"]), ("Alice", "age", "30", ["c1"]), ("Robert", "sameAs", "Bob", []), ("12", "knows", "Bob", []), ("", "knows", "Bob", [])]
    inst = [("Bob", "Person", ["c1"]), ("Bob", "12", []), ("Alice", "", ["c1"]), ("Carol", "", ["c4"])]
    classes = spark.createDataFrame([("Person", 0), ("42", 1)], "name string, ord bigint")
    g = settled(normalize.normalize_graph(small_graph(spark, inst, rel, classes=classes)))
    text = lambda df, c: df.agg(F.array_join(F.array_sort(F.collect_list(c)), ",")).first()[0]
    rows = [
        ("normalized", "instances", text(g.instances.select("name").distinct(), F.col("name"))), ("normalized", "types", text(g.instances, F.concat_ws(":", "name", "class_name"))), ("normalized", "relations", text(g.relations, F.concat_ws(" ", "subject", "predicate", "object", F.col("weight").cast("string")))),
        ("normalized", "values", text(g.data_values, F.concat_ws(" ", "entity", "property", "value"))), ("normalized", "hierarchy", text(g.hierarchy, F.concat_ws(">", "parent", "child"))),
    ]
    from weftgraph.operators.quality import review_quality

    ops = spark.createDataFrame([("knows", "Person", "Person", 0)], "name string, domain string, range string, ord bigint")
    bad = small_graph(spark, [("Alice", "Person", ["c"]), ("Bob", "Person", ["c"])], [("Alice", "knows", "Bob", ["c"]), ("Alice", "hates", "Ghost", ["c"])], classes=spark.createDataFrame([("Person", 0), ("Empty", 1)], "name string, ord bigint"), object_props=ops)
    report = review_quality(bad).first()
    rows += [("quality", k, str(report[k])) for k in ("dangling", "classes_without_instance", "ungoverned", "untyped", "completeness_pct", "domain_violation")]
    return told(spark, rows)


@states(
    ("cosine", "memberOf", "belongs"), ("resolve", "acme corp", "Acme Corp."), ("resolve", "Acme Corp", "Acme Corp."), ("chain", "a", "c"), ("chain", "b", "c"), ("circle", "y", "x"), ("predicates", "belongsTo", "3"), ("merge_predicates", "hired", "2"), ("vocabulary", "knows", "first"), ("canonicalized", "knows", ""), ("canonicalized", "relatedTo", "odd name"), ("canonicalized", "owns", ""),
    ("fk", "color_id", "group"), ("fk error", "", "foreign key 0: no to_pk_column"), ("dedup", "product a", "Product A"),
)
def fixture_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and predicates that mean one thing, and those that measures keep apart (800W, 600W)."""
    pair = "name string, canonical string"
    show = lambda df, what: df.select(F.lit(what).alias("what"), F.col("name").cast("string").alias("item"), F.col("canonical").cast("string").alias("value"))
    v = spark.createDataFrame([("belongs", [1.0, 0.0]), ("memberOf", [0.99, 0.01]), ("color", [0.0, 1.0])], "id string, v array<double>")
    out = show(cluster.cluster_by_cosine(v, 0.9), "cosine")
    inst = spark.createDataFrame([(n, "Org") for n in ("Acme Corp", "acme corp", "Acme Corp.", "Drill 800W", "Drill 600W", "2024-01-01")], "name string, class_name string")
    out = out.unionByName(show(cluster.resolve_renames(inst), "resolve"))
    out = out.unionByName(show(cluster.flatten_renames(spark.createDataFrame([("a", "b"), ("b", "c")], pair)), "chain")).unionByName(show(cluster.flatten_renames(spark.createDataFrame([("x", "y"), ("y", "x")], pair)), "circle"))
    rel = lambda rows: spark.createDataFrame([(s, p, o, None, i) for i, (s, p, o) in enumerate(rows)], "subject string, predicate string, object string, label string, ord bigint")
    props = spark.createDataFrame([("belongsTo", "", 0)], "name string, description string, ord bigint")
    folded = govern.govern_predicates(rel([("a", "belongs to", "b"), ("c", "belongs_to", "d"), ("e", "belongs-to", "f")]), props)
    out = out.unionByName(folded.groupBy("predicate").count().select(F.lit("predicates").alias("what"), F.col("predicate").alias("item"), F.col("count").cast("string").alias("value")))
    stems = govern.merge_predicates(rel([("a", "hired", "b"), ("c", "hired", "d"), ("a", "employed", "b")]))
    out = out.unionByName(stems.groupBy("predicate").count().select(F.lit("merge_predicates").alias("what"), F.col("predicate").alias("item"), F.col("count").cast("string").alias("value")))
    words = govern.vocabulary_of(spark.createDataFrame([("knows", "first", 0), ("knows", "second", 1), ("no name!", "", 2)], "name string, description string, ord bigint"))
    out = out.unionByName(words.select(F.lit("vocabulary").alias("what"), F.col("name").alias("item"), F.col("description").alias("value")))
    held = govern.canonicalize_predicates(rel([("a", "knows", "b"), ("a", "odd name", "c"), ("a", "possesses", "d")]), words, spark.createDataFrame([("possesses", "owns")], "predicate string, to string"))
    out = out.unionByName(held.select(F.lit("canonicalized").alias("what"), F.col("predicate").alias("item"), F.coalesce("label", F.lit("")).alias("value")))
    fine = profile.normalize_fk_relations([{"from_column": "color_id", "to_table": "group", "to_column": "id", "to_pk_column": "id"}], "colors", ["color_id"])
    try:
        profile.normalize_fk_relations([{"from_column": "x", "to_table": "t", "to_column": "id"}], "colors", ["x"])
        wrong = "none"
    except ValueError as e:
        wrong = str(e)
    rows = [("fk", fine[0]["from_column"], fine[0]["to_table"]), ("fk error", "", wrong)]
    twice = cluster.deduplicate(small_graph(spark, [("Product A", "P", []), ("product a", "P", [])]))
    rows += [("dedup", "product a", n["name"]) for n in twice.instances.select("name").distinct().collect()]
    return out.unionByName(told(spark, rows))


# models


CUT = '{"classes": [{"name": "Org"}], "entities": [{"entity": "A", "class": "Org"}, {"entity": "B", "cla'


@states(
    ("fence", "", '{"a":1}'), ("comma", "", '{"a":[1]}'), ("comment", "", '{"a":1,"b":"x"}'), ("curly quotes", "", '{"a":"b"}'), ("prose", "", '{"a":1}'), ("array", "", '{"entities":[{"entity":"A"}]}'), ("nothing", "", "{}"), ("cut", "", '{"classes":[{"name":"Org"}],"entities":[{"entity":"A","class":"Org"}]}'), ("cut item", "", '{"r":[{"u":1,"s":1}]}'), ("whole", "", "null"),
    ("invoke_json", "fails", "{}"), ("invoke_json_meta", "cut", "True False"), ("invoke_json_meta", "fails", "False True"), ("invoke_json_meta", "tells", "True False 7"), ("keys", "", '{"classes":[{"name":"Org"}],"entities":[{"name":"A"}]}'),
)
def fixture_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of models as they come: fenced, with comments or curly quotes, in prose, cut off."""
    read, cut = lambda t: compact(llm_json.parse_json_lenient(t)), lambda t: compact(llm_json.salvage_truncated(t))
    rows = [("fence", "", read('Here:\n```json\n{"a": 1}\n```\nDone.')), ("comma", "", read('{"a": [1,],}')), ("comment", "", read('// note\n{"a":1, // more\n"b":"x" /* end */}')), ("curly quotes", "", read("{“a”: “b”}")), ("prose", "", read('Sure: {"a": 1} as asked.')), ("array", "", read('[{"entity": "A"}]')), ("nothing", "", read("no json"))]
    rows += [("cut", "", cut(CUT)), ("cut item", "", cut('{"r":[{"u":1,"s":1},{"u":2,"s"')), ("whole", "", cut('{"a":1}'))]

    def fails(prompt: str, system: str) -> str:
        raise ConnectionError

    class Tells:
        def generate_json_meta(self, prompt: str, **_: object) -> tuple[dict, dict]:
            return {"a": 1}, {"out_tokens": 7, "truncated": True}

    meta = lambda m: llm_json.invoke_json_meta(m, "s", "u")
    a, b, c = meta(lambda prompt, system: CUT), meta(fails), meta(Tells())
    rows += [("invoke_json", "fails", compact(llm_json.invoke_json(fails, "s", "u"))), ("invoke_json_meta", "cut", f"{a.truncated} {a.failed}"), ("invoke_json_meta", "fails", f"{b.truncated} {b.failed}"), ("invoke_json_meta", "tells", f"{c.truncated} {c.failed} {c.out_tokens}")]
    return told(spark, [*rows, ("keys", "", compact(relations.normalized_keys({"클래스": [{"name": "Org"}], "instance": [{"entity": "A"}]})))])


def relation_model():  # noqa: ANN201
    """Relates the first two mentions of each unit; of several units at once, the answer is cut."""

    def answer(prompt: str, system: str) -> str:
        if "Define" in system:
            return '{"predicates": [{"name": "acquired", "description": "buys"}, {"name": "bad name"}, {"name": "abates"}]}'
        n = len(re.findall(r"^\[\d+\]", prompt, re.M))
        items = [f'{{"u": {i + 1}, "s": 1, "p": "acquired", "o": 2}}' for i in range(n)]
        return '{"relations": [' + items[0] + "]}" if n == 1 else '{"relations": [' + ", ".join(items[:1]) + ', {"u": 2, "s"'

    return answer


def extraction_model():  # noqa: ANN201
    """Types an entity by its own name at first, and fails on two chunks at once."""

    def answer(prompt: str, system: str) -> str:
        if "[2]" in prompt:
            return "not json"
        if system.startswith("Translate"):
            return compact({n: n.upper() for n in prompt.split("\n")})
        kind = "Company" if "kind, not its name" in system else "Alpha Corp"
        return compact({"entities": [{"entity": "Alpha Corp", "class": kind}, {"entity": "Beta", "class": "Beta" if kind != "Company" else kind}], "relations": [{"subject": "Alpha Corp", "predicate": "owns", "object": "Beta"}], "data_values": [{"entity": "Alpha Corp", "property": "founded", "value": "1990"}]})

    return answer


@states(
    ("relation", "u#0", "Alpha acquired Beta"), ("relation", "u#1", "Gamma acquired Delta"), ("vocabulary", "acquired", "buys"), ("vocabulary", "abates", ""), ("batches", "", "1,1"), ("instance", "Alpha Corp", "Company"), ("instance", "Beta", "Company"), ("value", "Alpha Corp", "founded 1990"), ("relation of documents", "Alpha Corp", "owns Beta"),
    ("extract_relations", "u#0", "Alpha acquired Beta"), ("extract_relations", "u#1", "Gamma acquired Delta"), ("grown", "rare", ""), ("translated", "a", "A"), ("translated", "b", "cached"), ("unit verified", "budget", "1500000000"), ("unit verified", "count", "42"), ("costs", "", "10.0 2.0"), ("sampled", "", "2"), ("groups", "", "1"), ("synonym", "Firm", "Company"), ("embedded", "a", "[1.0]"),
)
def fixture_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and graphs by models that answer in a stated way: cut answers are asked again in halves, failures too."""
    chunks = chunk_frame(spark, {"u": ["Alpha acquired Beta.", "Gamma acquired Delta."]})
    none = "name string, source_chunks array<string>"
    labels = facts.labels_by_chunk(spark.createDataFrame([], none), spark.createDataFrame([("Alpha", ["u#0"]), ("Beta", ["u#0"]), ("Gamma", ["u#1"]), ("Delta", ["u#1"])], none))
    units = settle(facts.build_units(chunks, labels).coalesce(1), "units")
    former = relations.RelationFormer(relation_model)
    words = former.define_vocabulary(units)
    show = lambda df, what: df.select(F.lit(what).alias("what"), F.col("chunk_id").alias("item"), F.concat_ws(" ", "subject", "predicate", "object").alias("value"))
    out = show(former.extract(units, words), "relation")
    ex = relations.DocumentExtractor(extraction_model)
    out = out.unionByName(show(relations.DocumentExtractor(relation_model).extract_relations(chunks, labels, words), "extract_relations"))
    made = ex.tables(settle(ex.extract(chunks.coalesce(1)), "found"))
    out = out.unionByName(made["instances"].select(F.lit("instance").alias("what"), F.col("name").alias("item"), F.col("class_name").alias("value")))
    out = out.unionByName(made["data_values"].select(F.lit("value").alias("what"), F.col("entity").alias("item"), F.concat_ws(" ", "property", "value").alias("value")))
    out = out.unionByName(made["relations"].select(F.lit("relation of documents").alias("what"), F.col("subject").alias("item"), F.concat_ws(" ", "predicate", "object").alias("value")))
    often = spark.createDataFrame([("rare",)] * 9 + [("acquired",)] * 5 + [("once",)], "predicate string")
    out = out.unionByName(former.grow_vocabulary(often, words).select(F.lit("grown").alias("what"), F.col("predicate").alias("item"), F.lit("").alias("value")))
    cache = spark.createDataFrame([("b", "cached")], "name string, translation string")
    out = out.unionByName(relations.translate_names(spark.createDataFrame([("a",), ("b",)], "name string"), extraction_model, cache).select(F.lit("translated").alias("what"), F.col("name").alias("item"), F.col("translation").alias("value")))
    values = spark.createDataFrame([("E", "budget", "150000000", ["t"]), ("E", "count", "42", ["t"])], "entity string, property string, value string, source_chunks array<string>")
    fixed = relations.verify_numeric_units(values, spark.createDataFrame([("t", "예산은 15억원이다")], "id string, text string"), {"억": 100_000_000})
    out = out.unionByName(fixed.select(F.lit("unit verified").alias("what"), F.col("property").alias("item"), "value"))
    costs = relations.Costs()
    costs.note(llm_json.Answer({}, out_tokens=20), 2, 1)
    u = [relations.Unit("d", "c", "x" * 40, ["a", "b"]) for _ in range(2)]
    classes = spark.createDataFrame([("Company", 0), ("Firm", 1), ("Person", 2)], "name string, ord bigint")
    same = relations.class_synonyms(classes, lambda: lambda prompt, system: '{"Firm": "Company", "Ghost": "Person"}')
    out = out.unionByName(same.select(F.lit("synonym").alias("what"), F.col("name").alias("item"), F.col("canonical").alias("value")))
    vectors = relations.embed(spark.createDataFrame([("a",)], "name string"), lambda: lambda names: [[float(len(n))] for n in names])
    out = out.unionByName(vectors.select(F.lit("embedded").alias("what"), F.col("id").alias("item"), F.col("v").cast("string").alias("value")))
    rows = [("vocabulary", k, v) for k, v in words.items()] + [("batches", "", ",".join(str(len(b)) for b in relations.plan_batches(u, 50))), ("costs", "", f"{costs.per_item} {costs.per_unit}"), ("sampled", "", former.sample_units(units).count()), ("groups", "", relations.group_documents(chunks).select("grp").distinct().count())]
    return out.unionByName(told(spark, rows))


# stores and exchange


@states(
    ("loaded", "Alice", "Person"), ("loaded", "Bob", "Person"), ("relation", "Alice", "knows Bob 2.0"), ("value", "Alice", "age 30"), ("enriched", "c1", ""), ("pruned", "Alice", "Person"), ("pruned", "Bob", "Person"), ("detached", "edges", "0"), ("cleared", "nodes", "0"), ("uri", "Alice", "urn:weft:instance#Alice"), ("schema", "Person", "Class"), ("schema", "age", "DatatypeProperty"), ("superseded", "knows", ""), ("renamed", "relatedTo", ""),
)
def fixture_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written, merged with, read, pruned, detached and cleared."""
    import uuid

    st = store.GraphStore(spark, f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}", "demo")
    classes = spark.createDataFrame([("Person", ["c1"], 0)], "name string, source_chunks array<string>, ord bigint")
    props = spark.createDataFrame([("age", "Person", "xsd:integer", 0)], "name string, domain string, range string, ord bigint")
    g = small_graph(spark, [("Alice", "Person", ["c1"]), ("Bob", "Person", ["c2"])], [("Alice", "knows", "Bob", ["c1", "c2"])], [("Alice", "age", "30", ["c1"])], classes=classes, data_props=props)
    g = g.with_(relations=g.relations.withColumn("weight", F.lit(2.0)))
    st.ensure_schema()
    st.write(g)
    st.mark_enriched(spark.createDataFrame([("c1",)], "chunk_id string"))
    back = st.load()
    frames = [names_of(back, "loaded"), back.relations.select(F.lit("relation").alias("what"), F.col("subject").alias("item"), F.concat_ws(" ", "predicate", "object", F.col("weight").cast("string")).alias("value")), back.data_values.select(F.lit("value").alias("what"), F.col("entity").alias("item"), F.concat_ws(" ", "property", "value").alias("value"))]
    frames += [back.enriched.select(F.lit("enriched").alias("what"), F.col("chunk_id").alias("item"), F.lit("").alias("value")), st.label_uris().filter("name = 'Alice'").select(F.lit("uri").alias("what"), F.col("name").alias("item"), F.col("uri").alias("value")), st.table("schema").select(F.lit("schema").alias("what"), F.col("element_name").alias("item"), F.col("element_type").alias("value"))]
    rows = [tuple(r) for f in frames for r in f.collect()]  # a fixture's rows, before the store moves on
    chunk = lambda c: spark.createDataFrame([(c,)], "chunk_id string")
    st.prune_chunks(chunk("c1"))
    rows += [tuple(r) for r in names_of(st.load(), "pruned").collect()]
    st.detach_chunks(chunk("c2"))
    rows.append(("detached", "edges", str(st.table("edges").filter("edge_kind = 'objectProperty'").count())))
    st.clear()
    rows.append(("cleared", "nodes", str(st.table("nodes").count())))
    edge = "subject_uri string, predicate string, object_uri string, predicate_uri string, edge_kind string, edge_weight double, label string, ord bigint"
    old = spark.createDataFrame([("a", "관련", "b", "", "objectProperty", 1.0, None, 0)], edge)
    renamed = store.rename_legacy(old)
    rows += [("renamed", r["predicate"], "") for r in renamed.collect()]
    new = spark.createDataFrame([("a", "knows", "b", "", "objectProperty", 1.0, None, 1)], edge)
    kept, _ = store.drop_superseded(renamed.unionByName(new), spark.createDataFrame([], store.TABLES["edge_sources"]), new)
    return told(spark, rows + [("superseded", r["predicate"], "") for r in kept.collect()])


TRIPLES = [("alice", "type", "Person"), ("alice", "type", "Robot"), ("Person", "subClassOf", "Agent"), ("alice", "knows", "bob")]


@states(
    ("class", "Agent", ""), ("class", "Person", ""), ("class", "Robot", ""), ("instance", "alice", "Person"), ("instance", "bob", ""), ("subclass", "Person", "Agent"), ("turtle", "", "inst:Alice :age \"30\"^^xsd:integer ."), ("turtle", "", "inst:Alice a :Person ."), ("xml", "urn:weft:instance#Alice", "Person"), ("sink", "g", "2"), ("fuseki", "", "http://h/ds/data"),
    ("search", "Alice", "1"), ("members", "Alice", ""), ("members", "Sub", ""), ("neighbor", "Alice", "knows Bob"), ("node", "Alice", ""), ("node", "nobody", ""), ("edge", "Alice", "instanceOf Person"), ("edge", "Alice", "knows Bob"), ("edge", "Person", "subClassOf Agent"), ("graph node", "Person", "class"), ("graph node", "Agent", "class"), ("graph node", "Alice", "instance"), ("graph node", "Bob", "instance"),
)
def fixture_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rdf.from_triples(spark.createDataFrame(TRIPLES, "s string, p string, o string").coalesce(1))
    out = got.classes.select(F.lit("class").alias("what"), F.col("name").alias("item"), F.lit("").alias("value")).unionByName(names_of(got, "instance")).unionByName(got.hierarchy.select(F.lit("subclass").alias("what"), F.col("child").alias("item"), F.col("parent").alias("value")))
    classes = spark.createDataFrame([("Person", 0), ("Agent", 1)], "name string, ord bigint")
    up = spark.createDataFrame([("Agent", "Person", 0)], "parent string, child string, ord bigint")
    g = small_graph(spark, [("Alice", "Person", []), ("Bob", "", [])], [("Alice", "knows", "Bob", [])], [("Alice", "age", "30", [])], classes=classes, hierarchy=up)
    t = settle(rdf.to_rdf_triples(g), "triples")
    lines = rdf.to_turtle(t).filter("line like 'inst:Alice :age%' or line = 'inst:Alice a :Person .'")
    out = out.unionByName(lines.select(F.lit("turtle").alias("what"), F.lit("").alias("item"), F.col("line").alias("value")))
    xml = rdf.to_owl_xml(t).filter("subject like '%Alice'")
    out = out.unionByName(xml.select(F.lit("xml").alias("what"), F.col("subject").alias("item"), F.regexp_extract("xml", "rdf:resource=.urn:weft:schema#(\\w+)", 1).alias("value")))
    sink = rdf.MemorySink()
    sink.upload(t.limit(1), "g", clear=True)
    sink.upload(t.limit(1), "g")
    lit, s, i = lambda s, p, o: (s, p, o, True, "", ""), rdf.SCHEMA, rdf.INSTANCE
    node = lambda s, p, o: (s, p, o, False, "", "")
    stored = spark.createDataFrame([lit(i + "Alice", rdf.RDFS + "label", "Alice"), node(i + "Alice", rdf.RDF + "type", s + "Person"), node(s + "Sub", rdf.RDFS + "subClassOf", s + "Person"), node(i + "Alice", s + "knows", i + "Bob")], "s string, p string, o string, o_is_literal boolean, datatype string, lang string")
    row = lambda df, what, item, value=F.lit(""): df.select(F.lit(what).alias("what"), item.alias("item"), value.cast("string").alias("value"))
    out = out.unionByName(row(reads.triples_search(stored, "alice"), "search", F.col("label"), F.col("score"))).unionByName(row(reads.triples_class_instances(stored, s + "Person"), "members", F.col("label")))
    out = out.unionByName(row(reads.triples_neighbors(stored, i + "Alice"), "neighbor", F.col("subject"), F.concat_ws(" ", "predicate", "object")))
    for uri in (i + "Alice", i + "nobody"):
        out = out.unionByName(row(reads.triples_node(stored, uri), "node", F.col("label")))
    out = out.unionByName(row(reads.graph_edges(g), "edge", F.col("subject"), F.concat_ws(" ", "predicate", "object"))).unionByName(row(reads.graph_nodes(g), "graph node", F.col("id"), F.col("kind")))
    return out.unionByName(told(spark, [("sink", "g", sink.graphs["g"].count()), ("fuseki", "", rdf.fuseki("http://h/", "ds").data_url)]))


def bundle_of(spark: SparkSession, text: str = "id,name\n1,Red\n2,Blue", revision: str = "v1", other: str = "") -> knowledge.Bundle:
    """A directory and a CSV; with ``other``, a second CSV."""
    res = [("root", "v1", "root", "directory", None, "", "", "{}"), ("colors", revision, "colors.csv", "file", "root", "text/csv", "", "{}")] + ([("other", "v7", "other.csv", "file", "root", "text/csv", "", "{}")] if other else [])
    page = '{"kind":"page","page":2}'
    chunks = [(f"colors:{revision}", "colors", revision, "p", text, 0, "", page, "{}")] + ([("other:v7", "other", "v7", "p", other, 0, "", "{}", "{}")] if other else [])
    R = knowledge.RECORDS
    return knowledge.bundle(spark, "demo", "input", resources=spark.createDataFrame(res, R["resources"]), chunks=spark.createDataFrame(chunks, R["chunks"]))


@states(
    ("entity", "Red", "instance"), ("entity", "Blue", "instance"), ("entity", "Colors", "class"), ("evidence", "colors:v1", ""), ("table bound", "Red", ""), ("table bound", "Blue", ""), ("table bound", "Colors", ""), ("imported", "Red", "Colors"), ("imported", "Blue", "Colors"), ("loaded", "facts", "same"), ("assembled", "Orange", ""), ("assembled", "Red", ""), ("violations", "sound", "0"), ("violations", "circle", "2"), ("violations", "broken", "3"),
    ("refused", "stale", "a fragment is of no current revision"), ("refused", "repeated", "fragments of another corpus, without a resource, or repeated"), ("cancelled", "", "OperationCancelled"), ("late", "", "TimeoutError"), ("budget", "", "BudgetExceeded"), ("canonical_json", "", '{"a":[1,"é"],"b":null}'), ("digest", "", "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a"), ("locator", "page", ""), ("locator", "span", "locator: span"), ("vector", "", "true"), ("vector", "zero", "false"),
)
def fixture_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle built, exported, imported, dumped and loaded; fragments assembled; what is unsound refused."""
    import time
    import uuid

    plain = GraphBuilder(spark, with_hierarchy=False, dedup=False, fold=False)
    build = lambda b, name="g": knowledge.build_knowledge(b, name, plain.build)
    keep = lambda b: b.with_(entities=settle(b.entities, "entities"), facts=settle(b.facts, "facts"), evidence=settle(b.evidence, "evidence"))
    first = keep(build(bundle_of(spark)))
    instances = first.entities.filter("label in ('Red', 'Blue', 'Colors')")
    out = instances.select(F.lit("entity").alias("what"), F.col("label").alias("item"), F.col("kind").alias("value")).unionByName(first.evidence.select(F.lit("evidence").alias("what"), F.col("chunk_id").alias("item"), F.lit("").alias("value")))
    out = out.unionByName(knowledge.table_bound_names(first).select(F.lit("table bound").alias("what"), F.col("label").alias("item"), F.lit("").alias("value"))).unionByName(names_of(knowledge.import_knowledge(first), "imported"))
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}/bundle"
    knowledge.dump(knowledge.validate(first), path)
    again = knowledge.load(spark, path)
    rows: list[tuple] = [("loaded", "facts", "same" if not again.facts.select("id", "predicate").exceptAll(first.facts.select("id", "predicate")).count() and again.facts.count() == first.facts.count() else "other")]
    both = bundle_of(spark, other="id,name\n3,Orange\n4,Pink")
    two = both.with_(resources=both.resources.filter("id <> 'colors'"), chunks=both.chunks.filter("resource_id = 'other'"))
    second = keep(build(knowledge.fragment(two)))
    one = keep(build(knowledge.fragment(bundle_of(spark))))
    whole = knowledge.assemble(both, [second, one], "all")
    out = out.unionByName(whole.entities.filter("label in ('Orange', 'Red')").select(F.lit("assembled").alias("what"), F.col("label").alias("item"), F.lit("").alias("value")))

    def refusal(f: Callable) -> str:
        try:
            f()
        except Exception as e:
            return str(e) if isinstance(e, knowledge.ContractError) else type(e).__name__
        return "none"

    rows += [("refused", "stale", refusal(lambda: knowledge.assemble(bundle_of(spark, revision="v2"), [one], "x"))), ("refused", "repeated", refusal(lambda: knowledge.assemble(bundle_of(spark), [one, one], "x")))]
    stop, late, few = knowledge.OperationContext(), knowledge.OperationContext(deadline=time.monotonic() - 1), knowledge.OperationContext(max_calls=1)
    stop.cancelled.set()
    few.consume()
    rows += [("cancelled", "", refusal(stop.check)), ("late", "", refusal(late.check)), ("budget", "", refusal(few.consume))]
    sound = bundle_of(spark)
    loop = sound.with_(resources=spark.createDataFrame([("a", "v1", "a", "directory", "b", "", "", "{}"), ("b", "v1", "b", "directory", "a", "", "", "{}")], knowledge.RECORDS["resources"]), chunks=sound.chunks.limit(0))
    broken = sound.with_(chunks=spark.createDataFrame([("k", "nowhere", "v1", "p", "abc", 0, "", '{"kind":"text_span","start":2,"end":9}', "{}"), ("k", "colors", "v2", "p", "abc", 0, "", "{}", "{}")], knowledge.RECORDS["chunks"]))
    wrong = knowledge.violations(broken).filter("what not like 'locator%'")
    rows += [("violations", "sound", knowledge.violations(sound).count()), ("violations", "circle", knowledge.violations(loop).filter("what = 'is its own ancestor'").count()), ("violations", "broken", wrong.count())]
    rows += [("canonical_json", "", knowledge.canonical_json({"b": None, "a": [1, "é"]})), ("digest", "", knowledge.digest({})), ("locator", "page", knowledge.py_locator_error('{"kind":"page","page":2}', "x")), ("locator", "span", knowledge.py_locator_error('{"kind":"text_span","start":2,"end":9}', "abc"))]
    v = spark.createDataFrame([("", [1.0, 0.0]), ("zero", [0.0, 0.0])], "item string, v array<double>")
    out = out.unionByName(v.select(F.lit("vector").alias("what"), "item", knowledge.validate_vector(F.col("v"), F.lit(2), F.lit("cosine")).cast("string").alias("value")))
    return out.unionByName(told(spark, rows))


# upkeep


@states(("extend", "same instances", "0"), ("retract", "same instances", "0"))
def fixture_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws: extending is building all; retracting is building what is left."""
    docs = lambda names: spark.createDataFrame([(n, f"<table><tr><td>기관명</td><td>예산</td></tr><tr><td>{n} 하나</td><td>1억</td></tr><tr><td>{n} 둘</td><td>2억</td></tr><tr><td>{n} 셋</td><td>3억</td></tr></table>") for n in names], "doc string, text string")
    b = GraphBuilder(spark, with_hierarchy=False, fold=False)
    a, ab = settled(b.build(docs(["가"]))), settled(b.build(docs(["가", "나"])))
    differ = lambda x, y: x.instances.select("name", "class_name").exceptAll(y.instances.select("name", "class_name")).count() + y.instances.select("name", "class_name").exceptAll(x.instances.select("name", "class_name")).count()
    more, less = settled(b.extend(a, docs(["가", "나"]))), settled(b.retract(ab, spark.createDataFrame([("나#0",)], "chunk_id string")))
    return told(spark, [("extend", "same instances", differ(more, ab)), ("retract", "same instances", differ(less, a))])


@states(("synced", "red!", "Colors"), ("synced", "green", "Colors"), ("second sync", "changed", "0"), ("communities", "", "a,b,c"), ("communities", "", "d,e,f"))
def fixture_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync follows edits, additions and deletions, and a second one has nothing to do; two triangles with a bridge are two communities."""
    b = GraphBuilder(spark, with_hierarchy=False)
    table = lambda data: star.Table("colors", spark.createDataFrame(data, "id int, name string"), ["id"], "id", "name", [], "db:colors")
    rows = [(1, "red"), (2, "blue")]
    before = b.build_rows(table(rows))
    from weftgraph.streaming.sync import diff_rows

    known = diff_rows(table(rows).rows, ["id", "name"], "id", spark.createDataFrame([], "key string, fingerprint string")).select("key", "fingerprint")
    g, prints = b.sync_rows(settled(before), table([(1, "red!"), (3, "green")]), settle(known, "prints"))
    prints = settle(prints, "prints")
    out = names_of(g, "synced")
    changed = diff_rows(table([(1, "red!"), (3, "green")]).rows, ["id", "name"], "id", prints).filter("change <> 'unchanged'").count()
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    found = b.communities(small_graph(spark, [(n, "N", []) for n in "abcdef"], [(x, "p", y, []) for x, y in two]))
    out = out.unionByName(found.select(F.lit("communities").alias("what"), F.lit("").alias("item"), F.array_join(F.array_sort("members"), ",").alias("value")))
    return out.unionByName(told(spark, [("second sync", "changed", changed)]))
