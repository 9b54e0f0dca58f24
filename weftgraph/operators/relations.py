"""Relations and graphs named by a language model: planning, prompts, answers, vocabulary. The model is a plain callable.

Units are grouped into batches of bounded size within documents; batches run where they are, through mapInPandas, with
a client made once for each task. Nothing of a corpus is collected; the vocabulary is the one shared, small thing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftgraph.functions import scores
from weftgraph.functions import text as T
from weftgraph.functions.llm_json import Answer, invoke_json, invoke_json_meta
from weftgraph.functions.values import schema_max_items
from weftgraph.operators.facts import build_units
from weftgraph.schemas import place

Model = Callable[[str, str], str]  # (prompt, system) -> answer; llm_json.invoke_json_meta names what else it may offer
CHARS, DEPTH, MAX_VOCABULARY, GROUP = 10_000, 3, 120, 300
FOUND = "doc string, chunk_id string, subject string, predicate string, object string, label string"


@dataclass
class Unit:
    doc: str
    chunk_id: str
    text: str
    mentions: list[str]
    is_row: bool = False
    heads: dict[str, str] = field(default_factory=dict)


def relation_schema(max_tokens: int, per_item: float = 0.0) -> dict:
    """JSON schema of an answer: unit, subject, predicate, object, as numbers and a name."""
    item = {"type": "object", "properties": {"u": {"type": "integer"}, "s": {"type": "integer"}, "p": {"type": "string"}, "o": {"type": "integer"}}, "required": ["u", "s", "p", "o"]}
    return {"type": "object", "properties": {"relations": {"type": "array", "items": item, "maxItems": schema_max_items(max_tokens, per_item)}}, "required": ["relations"]}


def extraction_schema(max_tokens: int = 0, relations: bool = True, relations_only: bool = False) -> dict:
    most = schema_max_items(max_tokens or 4096)
    text = {"type": "string"}
    array = lambda **props: {"type": "array", "maxItems": most, "items": {"type": "object", "properties": props}}
    out = {} if relations_only else {"classes": array(name=text, description=text, parent=text), "entities": array(name=text, **{"class": text}), "data_values": array(entity=text, property=text, value=text)}
    if relations or relations_only:
        out["relations"] = array(subject=text, predicate=text, object=text)
    return {"type": "object", "properties": out}


def relation_prompt(units: list[Unit], domain: str, vocabulary: dict[str, str]) -> str:
    lines = [f"Domain: {domain}"] if domain else []
    if vocabulary:
        lines += ["Predicates:", *(f"- {n}: {d}" if d else f"- {n}" for n, d in sorted(vocabulary.items()))]
    for i, u in enumerate(units, 1):
        lines += [f"[{i}] {u.text}", "    " + "; ".join(f"{k}={m}" for k, m in enumerate(u.mentions, 1))]
    return "\n".join(lines)


def parse_relations(units: list[Unit], answer: dict, allowed: set[str] | None = None) -> list[tuple[Unit, str, str, str]]:
    """Valid rows: numbers of units and mentions that exist, different ends, predicates of the vocabulary; each once."""
    out, seen = [], set()
    for r in answer.get("relations") or []:
        try:
            u = units[int(r["u"]) - 1] if int(r["u"]) > 0 else None
            s, o = int(r["s"]), int(r["o"])
        except (KeyError, TypeError, ValueError, IndexError):
            continue
        p = str(r.get("p") or "").strip()
        if u is None or not p or s == o or not (0 < s <= len(u.mentions) and 0 < o <= len(u.mentions)) or (allowed is not None and p not in allowed):
            continue
        key = (id(u), u.mentions[s - 1], p, u.mentions[o - 1])
        if key not in seen:
            seen.add(key)
            out.append((u, key[1], p, key[3]))
    return out


def plan_batches(units: list[Unit], budget: int = CHARS, answers: int = 60) -> list[list[Unit]]:
    """Greedy, in order: text and mentions within the budget, expected relations within an answer."""
    out: list[list[Unit]] = []
    chars = rows = 0
    for u in units:
        size, more = len(u.text) + sum(map(len, u.mentions)), max(1, len(u.mentions) - 1)
        if not out or chars + size > budget or rows + more > answers:
            out.append([])
            chars = rows = 0
        out[-1].append(u)
        chars, rows = chars + size, rows + more
    return out


@dataclass
class Costs:
    """What answers cost, learned as they come: a moving mean of tokens an item and of items a unit. One a task: it sizes its next batches."""

    max_tokens: int = 4096
    per_item: float = 0.0
    per_unit: float = 0.0

    def note(self, answer: Answer, items: int, units: int) -> None:
        mean = lambda old, new: new if not old else 0.7 * old + 0.3 * new
        if items and answer.out_tokens and not answer.truncated:
            self.per_item = mean(self.per_item, answer.out_tokens / items)
        if units and not answer.failed:
            self.per_unit = mean(self.per_unit, items / units)
        if answer.truncated:  # what came was not all: assume more
            self.per_item = max(self.per_item, self.max_tokens / max(items, 1) if items else self.per_item)

    def most_items(self) -> int:
        return schema_max_items(self.max_tokens, self.per_item)


def classify(model: Model, units: list[Unit], domain: str, vocabulary: dict[str, str], depth: int = DEPTH, costs: Costs | None = None) -> list[tuple[Unit, str, str, str]]:
    """A batch's relations. An answer that was cut is kept and its units asked again in halves; an empty one is asked once more."""
    costs = costs or Costs()
    system = "Name the relations between the numbered mentions of each text. Answer as JSON."
    for _ in range(2):
        answer = invoke_json_meta(model, system, relation_prompt(units, domain, vocabulary), relation_schema(costs.max_tokens, costs.per_item), costs.max_tokens)
        found = parse_relations(units, answer.value, set(vocabulary) or None)
        costs.note(answer, len(answer.value.get("relations") or []), len(units))
        if answer.truncated and depth and len(units) > 1:
            half = len(units) // 2
            rest = [r for part in (units[:half], units[half:]) for r in classify(model, part, domain, vocabulary, depth - 1, costs)]
            known = {(id(u), s, p, o) for u, s, p, o in found}
            return found + [r for r in rest if (id(r[0]), *r[1:]) not in known]
        if found or answer.value.get("relations"):
            return found
    return []


class RelationFormer:
    """``client``: makes a Model, once a task."""

    def __init__(self, client: Callable[[], Model], domain: str = "", budget: int = CHARS) -> None:
        self.client, self.domain, self.budget = client, domain, budget

    def sample_units(self, units: DataFrame, most: int = 200) -> DataFrame:
        """An even sample by hash, of about ``most`` units."""
        n = units.count()
        share = min(1.0, most / max(n, 1))
        return units.filter(F.pmod(F.xxhash64("doc", "chunk_id", "unit"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def define_vocabulary(self, units: DataFrame, most: int = 200) -> dict[str, str]:
        """Names and definitions, from a bounded sample."""
        rows = self.sample_units(units, most).orderBy("doc", "chunk_id", "unit").limit(2 * most).collect()
        sample = [Unit(r["doc"], r["chunk_id"], r["text"], list(r["mentions"])) for r in rows]
        if not sample:
            return {}
        answer = invoke_json(self.client(), "Define predicates for these relations as JSON: predicates, each with name and description.", relation_prompt(sample, self.domain, {}))
        found = {str(p.get("name", "")).strip(): str(p.get("description") or "") for p in answer.get("predicates") or [] if isinstance(p, dict)}
        good = {n: d for n, d in found.items() if n and n.replace("_", "").isalnum() and n.isascii()}
        return dict(list(good.items())[:MAX_VOCABULARY])  # the first ones, in the model's order: the feature's limit

    def extract(self, units: DataFrame, vocabulary: dict[str, str] | None = None) -> DataFrame:
        """FOUND rows of units (doc, chunk_id, unit, text, is_row, mentions, heads); documents come in groups, whole or in part."""
        client, domain, budget, words = self.client, self.domain, self.budget, vocabulary or {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = client()
            costs = Costs()
            for pdf in batches:
                items = [Unit(r.doc, r.chunk_id, r.text, list(r.mentions), bool(r.is_row), dict(r.heads or {})) for r in pdf.itertuples()]
                rows = []
                for part in plan_batches(items, budget, costs.most_items()):
                    rows += [(u.doc, u.chunk_id, s, p, o, (u.heads.get(o) or u.heads.get(s)) if u.is_row else None) for u, s, p, o in classify(model, part, domain, words, costs=costs)]
                yield pd.DataFrame(rows, columns=["doc", "chunk_id", "subject", "predicate", "object", "label"])

        cols = ["doc", "chunk_id", "unit", "text", "is_row", "mentions", "heads"]
        return units.select(*cols).sortWithinPartitions("doc", "chunk_id", "unit").mapInPandas(run, FOUND)

    def grow_vocabulary(self, found: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
        """(predicate) out of the vocabulary that stand out by frequency."""
        other = found.filter(~F.col("predicate").isin(*vocabulary)) if vocabulary else found
        counts = other.groupBy("predicate").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "predicate").limit(10 * MAX_VOCABULARY)
        k = scores.natural_cut(counts)
        ranked = counts.withColumn("_n", F.row_number().over(W.orderBy(F.desc("score"), "predicate")))  # of a bounded list
        return ranked.join(k).filter("_n <= k").select("predicate")


# Other names that models give to an answer's members, and to those of its items.
KEYS = {"class": "classes", "concepts": "classes", "클래스": "classes", "entity": "entities", "instance": "entities", "instances": "entities", "개체": "entities", "relation": "relations", "관계": "relations", "attributes": "data_values", "values": "data_values", "속성": "data_values"}
ITEM_KEYS = {"entity": "name", "type": "class", "class_name": "class", "head": "subject", "tail": "object", "relation": "predicate", "attribute": "property"}


def normalized_keys(answer: dict) -> dict:
    """An answer under the names that the schema has."""
    out: dict = {}
    for k, items in answer.items():
        kind = KEYS.get(k.strip().lower(), k.strip().lower())
        rename = {a: b for a, b in ITEM_KEYS.items() if not (kind == "data_values" and a == "entity")}
        rows = [{rename.get(x, x): v for x, v in i.items()} if isinstance(i, dict) else {"name": i} for i in items] if isinstance(items, list) else []
        out[kind] = out.get(kind, []) + rows
    return out


class DocumentExtractor:
    """Classes, entities, relations and values of chunks in one answer each batch; a batch that fails is halved."""

    def __init__(self, client: Callable[[], Model], budget: int = CHARS) -> None:
        self.client, self.budget = client, budget

    def extract(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, kind, a, b, c): class (name, parent, description), entity (name, class), relation (s, p, o), value (entity, property, value)."""
        client, budget = self.client, self.budget

        def ask(model: Model, part: list[tuple[str, str]], depth: int) -> list[tuple]:
            body = "\n\n".join(f"[{i}] {t}" for i, (_, t) in enumerate(part, 1))
            got = normalized_keys(invoke_json(model, "Extract classes, entities, relations and data_values as JSON.\n" + json.dumps(extraction_schema()), body, extraction_schema()))
            if not got and depth and len(part) > 1:
                h = len(part) // 2
                return ask(model, part[:h], depth - 1) + ask(model, part[h:], depth - 1)
            got = repaired(model, body, got)
            out = []
            text = lambda r, k: str(r.get(k) or "").strip()
            for name, kind, keys in (("classes", "class", ("name", "parent", "description")), ("entities", "entity", ("name", "class", "")), ("relations", "relation", ("subject", "predicate", "object")), ("data_values", "value", ("entity", "property", "value"))):
                for r in got.get(name) or []:
                    if isinstance(r, dict) and text(r, keys[0]):
                        home = next((c for c, t in part if text(r, keys[0]) in t), part[0][0])
                        out.append((home, kind, *(text(r, k) if k else None for k in keys)))
            return out

        def repaired(model: Model, body: str, got: dict) -> dict:
            """Asked once more where half of the entities or more are typed as themselves."""
            ents = [e for e in got.get("entities") or [] if isinstance(e, dict)]
            selfs = sum(e.get("name") == e.get("class") for e in ents)
            if ents and 2 * selfs >= len(ents):
                return normalized_keys(invoke_json(model, "The class of an entity is its kind, not its name. Extract again as JSON.", body)) or got
            return got

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = client()
            for pdf in batches:
                rows, part, size = [], [], 0
                for cid, t in zip(pdf["id"], pdf["text"].fillna(""), strict=True):
                    if part and size + len(t) > budget:
                        rows += ask(model, part, DEPTH)
                        part, size = [], 0
                    part.append((cid, t))
                    size += len(t)
                if part:
                    rows += ask(model, part, DEPTH)
                yield pd.DataFrame(rows, columns=["chunk_id", "kind", "a", "b", "c"])

        return chunks.select("id", "text").mapInPandas(run, "chunk_id string, kind string, a string, b string, c string")

    def extract_relations(self, chunks: DataFrame, labels: DataFrame, vocabulary: dict[str, str] | None = None, domain: str = "") -> DataFrame:
        """Relations alone, between known labels (chunk_id, labels) of chunks: FOUND rows, by a RelationFormer of the same model."""
        return RelationFormer(self.client, domain, self.budget).extract(build_units(chunks, labels), vocabulary)

    def tables(self, found: DataFrame, morphology: Callable[[], T.Morphology] = lambda: T.NO_MORPHOLOGY) -> dict[str, DataFrame]:
        """Layout tables; names that read like sentences are shortened to the nouns they begin with; a value that is an entity
        is a relation, and the other way round a relation to no entity a value."""
        if morphology().analyze is not None:
            found = shortened(found, morphology)
        at = lambda *c: place(*c).alias("ord")
        ch = F.array_sort(F.collect_set("chunk_id")).alias("source_chunks")
        ent = found.filter("kind = 'entity'").groupBy("a", "b").agg(ch).select(F.col("a").alias("name"), F.coalesce("b", F.lit("")).alias("class_name"), F.lit("").alias("identity"), "source_chunks", at("a", "b"))
        names = ent.select("name").distinct()
        cls = found.filter("kind = 'class'").groupBy("a").agg(F.max("b").alias("parent"), F.max("c").alias("description"), ch).select(F.col("a").alias("name"), "description", "parent", F.lit("").alias("source"), "source_chunks", at("a"))
        three = found.filter("kind in ('relation', 'value')").filter("b <> '' and c <> ''").join(names.select(F.col("name").alias("c"), F.lit(True).alias("_e")), "c", "left")
        number = F.col("c").rlike("^[\\s(]*[+\\-]?[\\d,.]+")
        rel = three.filter(F.col("_e") | ((F.col("kind") == "relation") & ~number)).groupBy("a", "b", "c").agg(ch)
        val = three.filter(F.col("_e").isNull() & ((F.col("kind") == "value") | number)).groupBy("a", "b", "c").agg(ch)
        rel = rel.select(F.col("a").alias("subject"), F.col("b").alias("predicate"), F.col("c").alias("object"), F.lit("ObjectProperty").alias("predicate_type"), F.lit(1.0).alias("weight"), "source_chunks", at("a", "b", "c"))
        val = val.select(F.col("a").alias("entity"), F.col("b").alias("property"), F.col("c").alias("value"), F.lit("xsd:string").alias("value_type"), "source_chunks", at("a", "b", "c"))
        return {"classes": cls, "instances": ent, "relations": rel, "data_values": val}


def shortened(found: DataFrame, morphology: Callable[[], T.Morphology]) -> DataFrame:
    """Rows with the names of entities, and of relations' and values' ends, as T.Morphology.shortened() has them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = morphology()
        for pdf in batches:
            ends = {"entity": ("a",), "relation": ("a", "c"), "value": ("a",)}
            for kind, cols in ends.items():
                for c in cols:
                    at = (pdf["kind"] == kind) & pdf[c].notna()
                    pdf.loc[at, c] = pdf.loc[at, c].map(m.shortened)
            yield pdf

    return found.mapInPandas(run, found.schema)


def class_synonyms(classes: DataFrame, client: Callable[[], Model], most: int = 500) -> DataFrame:
    """(name, canonical) of classes that a model calls synonyms: asked once about three classes at least and ``most``, the feature's limit, at most."""
    names = [r["name"] for r in classes.filter("coalesce(name, '') <> ''").groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord", "name").limit(most).collect()]
    answer = invoke_json(client(), "Which of these classes mean the same? Answer as a JSON object of name to the name to keep.", "\n".join(names)) if len(names) >= 3 else {}
    known = set(names)
    pairs = sorted((a, b) for a, b in answer.items() if isinstance(b, str) and a in known and b in known and a != b)
    return classes.sparkSession.createDataFrame(pairs, "name string, canonical string")


def translate_names(names: DataFrame, client: Callable[[], Model], cache: DataFrame, batch: int = 50) -> DataFrame:
    """(name, translation): cached ones, and the rest asked in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for pdf in batches:
            todo, rows = sorted(pdf["name"]), []
            for k in range(0, len(todo), batch):
                part = todo[k : k + batch]
                got = invoke_json(model, "Translate each name into English. Answer as a JSON object of name to translation.", "\n".join(part))
                rows += [(n, str(got[n])) for n in part if got.get(n)]
            yield pd.DataFrame(rows, columns=["name", "translation"])

    new = names.select("name").distinct().join(cache.select("name"), "name", "left_anti")
    return cache.select("name", "translation").unionByName(new.mapInPandas(run, "name string, translation string"))


def verify_numeric_units(values: DataFrame, texts: DataFrame, scales: dict[str, int]) -> DataFrame:
    """Values (entity, property, value, source_chunks) that are a power of ten off what their text writes with a unit, set right."""
    out = values.withColumn("_n", F.expr("try_cast(replace(value, ',', '') AS double)"))
    forms = F.array(*[F.struct(F.lit(u).alias("u"), F.lit(float(s)).alias("s")) for u, s in sorted(scales.items())])
    cited = out.withColumn("_id", F.monotonically_increasing_id()).select("_id", *values.columns, "_n")
    src = cited.filter("_n is not null").select("_id", "_n", F.explode("source_chunks").alias("id")).join(texts.select("id", "text"), "id").withColumn("f", F.explode(forms))
    marks = F.regexp_extract_all("text", F.concat(F.lit("([\\d,.]*\\d)\\s*"), F.col("f.u")), F.lit(1))
    seen = src.withColumn("m", F.explode(marks)).withColumn("x", F.expr("try_cast(replace(m, ',', '') AS double)") * F.col("f.s")).filter("x is not null and x <> 0 and _n <> 0")
    off = F.log10(F.abs(F.col("x") / F.col("_n")))
    fix = seen.filter((F.abs(off - F.round(off)) < 1e-9) & (F.round(off) != 0)).groupBy("_id").agg(F.min("x").alias("_x"))
    exact = seen.filter("x = _n").select("_id").distinct()
    fix = fix.join(exact, "_id", "left_anti")
    text = F.regexp_replace(F.format_string("%.6f", F.col("_x")), "\\.?0+$", "")
    return cited.join(fix, "_id", "left").withColumn("value", F.when(F.col("_x").isNotNull(), text).otherwise(F.col("value"))).select(*values.columns)


def group_documents(chunks: DataFrame, size: int = GROUP) -> DataFrame:
    """(doc, grp): whole documents in groups of about ``size`` chunks, by hash: groups of even size, with no order over all."""
    n = chunks.count()
    groups = max(1, -(-n // size))
    return chunks.select("doc").distinct().withColumn("grp", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int"))


def embed(names: DataFrame, client: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """(id, v) of names, by an embedder made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = client()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["name"], "v": f(pdf["name"].tolist())})

    return names.select("name").distinct().mapInPandas(run, "id string, v array<double>")


RELATED = T.RELATED
