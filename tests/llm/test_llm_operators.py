"""The operators against brute force, exact round trips and held-out accuracy, with nulls, empties, ties and repeats."""

import hashlib
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import ann, bpe, licenses, mixing, neardup, pii, queries, toolcalls, topk, toxicity, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, extra=()):
    rows = [(i, t, ("en", "de", "", None)[i % 4], f"src{i % 7}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [f"w{i}" for i in range(400)]


def shingles(text, k):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs.items()}
    comp = {d: d for d in docs}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rng = random.Random(k)
    texts = [None, "", "  \t ", "one", "ONE", "one two", "a b c d", "a b c d e"]
    for n in (4, 9, 20, 60, 200, 700):
        for _ in range(3):
            base = prose(rng, n).split()
            texts.append(" ".join(base))
            for share in (0.01, 0.03, 0.06, 0.1):
                other = list(base)
                for _ in range(max(1, int(share * n / k))):
                    other[rng.randrange(n)] = "changed" + str(rng.randrange(9))
                texts.append(" ".join(other))
    texts += [texts[-1]] * 30
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in neardup.classes(docs, k, 80).collect()}
    want = components(dict(enumerate(texts)), k, 80)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items())
    kept = {r["doc_id"] for r in neardup.drop(docs, k, 80).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.classes(docs, 2, 80).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.classes(docs.limit(0), 2, 80).count() == 0


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:3500], rng.integers(0, 2**64, 500, dtype=np.uint64)]))
    x, y = neardup.unpack([neardup.pack(neardup.registers(a))]), neardup.unpack([neardup.pack(neardup.registers(b))])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.estimate(((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1))[0] - true) < 0.06


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    texts = [None, "", " ", "\n\n  a\t b", "Hello, world! It's 42°C.", "naïve café ÄÖÜ", "Привет мир", "日本語 한국어", "🙂🙂 é ​", "<|endoftext|> x <|endoftext|>", "x" * 20_000, "word " * 5000, "a b\x85c\x1cd", "�\x00"]
    got = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts), queries.tokenizer()).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, repr(t)[:40]
    two_steps = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(frame(spark, texts), queries.tokenizer()), queries.tokenizer()).collect()}
    assert two_steps == {i: t or "" for i, t in enumerate(texts)}


def test_bpe_of_many_blocks_shuffles_words_and_ids_alone(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer())
    rng = random.Random(11)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}é" for _ in range(300)) + " the same end" for _ in range(120)]
    texts += [texts[0], None, "", "<|endoftext|>", "it's\n\n <|endoftext|> the same end"]
    rows = frame(spark, texts).repartition(9)
    df = bpe.digests(rows.unionAll(rows.limit(1).withColumn("doc_id", F.lit(None).cast("bigint"))), queries.tokenizer(), with_ids=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(range" in plan and "Exchange hashpartitioning(of_block" in plan
    assert "Exchange hashpartitioning(block" not in plan  # texts' word numbers stay where they were written
    got = df.collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == list(range(len(texts))) and len(got) == len(texts) + 1
    for r in got:
        if r["doc_id"] is not None:
            ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
            assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("weft_")]


def vectors(spark, n=900, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    m = (centres[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, d))).astype(np.float32)
    m[n // 2 : n // 2 + 50] = m[0]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(m)]
    odd = [(n, None, 0), (n + 1, [1.0] * (d - 1) + [None], 0), (n + 2, [float("nan")] * d, 0), (n + 3, [float("inf")] * d, 0), (None, [1.0] * d, 0), (n + 40, [0.0] * d, 0)]
    return m, spark.createDataFrame([*rows, *odd], "vec_id bigint, embedding array<float>, label int").repartition(5)


def test_topk_is_exact(spark):
    m, df = vectors(spark)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.vstack([m, np.zeros((1, m.shape[1]), np.float32)])
    ids = np.array([*range(len(m)), len(m) + 40])
    e = np.floor(256 * whole.astype(np.float64)).astype(np.int64)
    for q in [i for i in ids if i % 50 == 0]:
        s = e @ e[np.flatnonzero(ids == q)[0]]
        best = sorted((-int(x), int(i)) for x, i in zip(s, ids, strict=True) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -x) for k, (x, i) in enumerate(best)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0, 5).count() == 2


def test_ann_recall(spark):
    m, df = vectors(spark, 6000)
    rows = ann.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    x = m.astype(np.float64)
    hit = total = 0
    for q in range(0, len(m), 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = [r for r in rows if r["query_id"] == q]
        assert len(mine) == 20 and [r["rank"] for r in sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in mine)
        least = np.sort(s)[-20]
        hit += sum(r["score"] >= least - 1e-9 for r in mine)
        total += 20
    assert hit / total >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


@pytest.mark.parametrize("sigma", [0.0, 1.0])
def test_ann_recall_beyond_the_sample_and_with_unequal_norms(spark, sigma):
    rng = np.random.default_rng(3)
    n = 4 * ann.SAMPLE
    m = rng.standard_normal((n, 16))
    m *= rng.lognormal(0, sigma, (n, 1)) / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(m.tolist())), "vec_id long, embedding array<double>")
    rows = ann.search(df, F.col("vec_id") % 100 == 0, 20).collect()
    asked = np.arange(0, n, 100)
    s = m[asked] @ m.T
    s[np.arange(len(asked)), asked] = -np.inf
    least = dict(zip(asked.tolist(), np.partition(s, -20, 1)[:, -20], strict=True))
    recall = sum(r["score"] >= least[r["query_id"]] - 1e-9 for r in rows) / (20 * len(asked))
    print("recall", sigma, recall)
    assert recall >= 0.9


def test_partitions_are_balanced():
    rng = np.random.default_rng(1)
    near = ann.neighbours(rng.standard_normal((1000, 8)), 8)
    sizes = np.bincount(ann.partition_graph(near, 8))
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 8


def test_url_rules(spark):
    urls = ["https://Example.NET/en/x?y", "http://a.b.example.net/en", "http://example.com/de/", "http://example.com/dex", "http://x.org/fr/a#b", "http://x.org/", "mailto:x", None, "", "://", "http://net/", "http://badnet/", "ftp://sub.spam-farm.example.com/x", "http://spam-farm.example.com.de/", "http://x.net?/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*urls, urls[0]])], "page_id bigint, url string, html string")
    rules = {"net/": "block", "example.com/de/": "block", "example.net/en/": "allow", "org/fr/": "allow"}

    def want(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fit = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        spam = any(host == h or host.endswith("." + h) for h in queries.LISTED_HOSTS)
        return host, path, rule, rules[rule] if rule else "block" if spam else "allow"

    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages, queries.BLOCK, queries.ALLOW, queries.LISTED_HOSTS).collect()}
    assert got == {i: want(u) for i, u in enumerate([*urls, urls[0]])}
    assert url_filter.judge(pages.limit(0), queries.BLOCK, queries.ALLOW, queries.LISTED_HOSTS).count() == 0


@pytest.mark.parametrize("most", [url_filter.MAX_BITS, 640])
def test_cascade_is_exact_over_its_universe(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MAX_BITS", most)
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
    listed = [f"k{i}" for i in range(0, 20_000, 97)]
    cascades = url_filter.build(keys, listed)
    assert all(len(levels) >= 2 for levels in cascades) and (len(cascades) > 1) == (most == 640)
    got = {r[0] for r in url_filter.marked(keys, ["key"], cascades, ["hit"]).filter("hit").collect()}
    assert got == set(listed)
    assert url_filter.build(keys, spark.createDataFrame([], "key string")) == []


def test_hosts_of_a_frame_are_judged_as_those_of_a_list(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.b.c/x", "http://b.c", "http://c/", "http://x.a.b.c.d/"])], "page_id long, url string")
    hosts = ["b.c", "a.b.c.d"]
    want = {0: "block", 1: "block", 2: "allow", 3: "block"}
    for listed in (hosts, spark.createDataFrame([(h,) for h in hosts], "host string")):
        assert {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], [], listed).collect()} == want


def test_surrogates_keep_type_and_coreference(spark):
    texts = ["Mail anna@example.com or Anna@Example.com, ssn 123-45-6789.", "again anna@example.com; Mr. John Smith met Mary Smith", "ip 10.0.0.1, card 4111 1111 1111 1111, +49 30 1234567", "plain text", None, "", "password=hunter2hunter2"]
    docs = frame(spark, texts).withColumn("e", F.lit("a column named as the spans"))
    rows = {r["doc_id"]: r for r in pii.checked(docs, spans="e").collect()}
    assert rows[3]["text"] == "plain text" and rows[4]["text"] is None and rows[5]["text"] == ""
    found = [(i, e, texts[i][e["start"] : e["end"]]) for i, r in rows.items() for e in r["e"]]
    of = {(e["type"], pii.canonical(e["type"], o)): pii.canonical(e["type"], e["surrogate"]) for _, e, o in found}
    assert len(set(of.values())) == len(of) and all(k[1] != v for k, v in of.items())
    assert len({e["surrogate"].lower() for _, e, _ in found if e["type"] == "email"}) == len({e["entity"] for _, e, _ in found if e["type"] == "email"}) == 1
    card = next(e["surrogate"] for _, e, _ in found if e["type"] == "card")
    digits = card.replace(" ", "")
    assert pii.luhn(digits[:-1]) == int(digits[-1]) and len(card) == 19
    assert {"anna@example.com", "123-45-6789", "10.0.0.1", "hunter2hunter2"}.isdisjoint(" ".join(r["text"] or "" for r in rows.values()).split(" "))
    assert not any(o in str(e) for _, e, o in found)


def test_texts_around_entities_stay(spark):
    """Brute force: every text is its parts between the spans, with the spans' surrogates between them, and nothing else is found in it."""
    rng = random.Random(11)
    whats = ["anna.b@mail.example.org", "+44 20 7946 0958", "078-05-1120", "192.168.7.9", "5500 0000 0000 0004", "Dr. Łukasz Žižka", "token: abcdEFGH1234", "GB82 WEST 1234 5698 7654 32"]
    texts, want = [], []
    for _ in range(60):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(1, 6)):
            words = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8))) + " "
            what = rng.choice(whats)
            begin = at + len(words) + (4 if what.startswith("Dr. ") else 7 if what.startswith("token") else 0)
            parts.append(words + what + " ; ")
            spans.append((begin, at + len(words) + len(what)))
            at += len(parts[-1])
        texts.append("".join(parts))
        want.append(spans)
    for r in pii.anonymise(frame(spark, texts), spans="e").collect():
        t, out, last = texts[r["doc_id"]], "", 0
        assert [(e["start"], e["end"]) for e in r["e"]] == want[r["doc_id"]]
        for e in r["e"]:
            assert len(e["surrogate"]) == e["end"] - e["start"] or e["type"] == "ip"
            out += t[last : e["start"]] + e["surrogate"]
            last = e["end"]
        assert r["text"] == out + t[last:]


@pytest.mark.parametrize("text, name", [("met Wei Zhang today", "Wei Zhang"), ("met Fatima Haddad today", "Fatima Haddad"), ("Mr. Øystein Łukasz came", "Øystein Łukasz"), ("my name is Kofi Mensah.", "Kofi Mensah"), ("어제 김민수 씨가 왔다", "김민수"), ("昨天，王小明先生来了", "王小明"), ("قابلت السيد محمود درويش اليوم", "محمود درويش")])
def test_names_of_many_scripts(text, name):
    assert [text[a:z] for a, z, kind in pii.find(text) if kind == "name"] == [name]
    new, _ = pii.replace(text, b"k")
    assert name not in new and len(new.split()) == len(text.split())


def test_capitals_of_letters_without_one_stay():
    words = ["ÂN", "COK", "STRAßE", "GROẞ", "İZMİR", "ÀÉ"]
    for key in (b"a", b"b", b"c"):
        new = [pii._cased(w, key) for w in words]
        assert len(set(new)) == len(new) and all(len(a) == len(b) and a != b for a, b in zip(new, words, strict=True))


def test_permutation_is_one():
    assert sorted(pii.permute(x, 1000, b"k", "t") for x in range(1000)) == list(range(1000))


def test_mixing_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(400)] + [None, ""]
    docs = frame(spark, texts)
    weights = {("web",): 0.7, ("other",): 0.3}
    domain = F.when(F.col("source").isin("src0", "src1"), "web").otherwise("other")
    rows = mixing.mix(docs, domain, weights, max_epochs=3).collect()
    leaf = lambda r: ("web" if r["source"] in ("src0", "src1") else "other", r["lang"] or "?", r["source"] or "?")
    have, got = {}, {}
    for r in docs.collect():
        have[leaf(r)] = have.get(leaf(r), 0) + len((r["text"] or "").split())
    for r in rows:
        got[leaf(r)] = got.get(leaf(r), 0) + len((r["text"] or "").split())
    root = mixing.tree({k: float(v) for k, v in have.items()}, weights, 3)
    mixing.allocate(root, sum(have.values()))
    for node in mixing.leaves(root):
        assert node.budget - 30 <= got.get(node.name, 0) <= node.budget + 1e-6
    assert abs(sum(n.budget for n in mixing.leaves(root)) - sum(have.values())) < 1e-6
    seen = [(r["doc_id"], r["mix_epoch"]) for r in rows]
    assert len(seen) == len(set(seen)) and {d for d, e in seen if e == 1} <= {d for d, e in seen if e == 0}
    assert sorted(seen) == sorted((r["doc_id"], r["mix_epoch"]) for r in mixing.mix(docs.repartition(7), domain, weights, max_epochs=3).collect())
    assert mixing.mix(docs.limit(0), domain, weights).count() == 0


def test_mixing_starts_no_python_workers(spark):
    docs = frame(spark, [f"text {i}" for i in range(40)], [(None, None, None, None, None)])
    df = mixing.mix(docs, F.lit("d"), {}, total=1.5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # rows of the plan are the driver's, not an RDD that Python workers make
    assert re.search(r"LocalTableScan \[[^]]*_cut", plan) and not re.search(r"Scan ExistingRDD\[[^]]*_cut", plan)
    assert df.count() > 41
    made = mixing.few_rows(spark, [("a", None, 1, 0.5)], "_d string, _l string, _whole int, _rest double")
    assert made.dtypes == [("_d", "string"), ("_l", "string"), ("_whole", "int"), ("_rest", "double")]
    assert [tuple(r) for r in made.collect()] == [("a", None, 1, 0.5)]
    assert mixing.few_rows(spark, [], "_d string, _cut bigint").count() == 0


def test_mixing_takes_what_an_independent_allocator_gives(spark):
    """Brute force: budgets by bisection of one water level a node, then prefixes of each leaf's epochs, document by document."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(300)]
    docs = frame(spark, texts)
    weights = {("web",): 0.8, ("other",): 0.2, ("web", "en"): 3.0, ("web", "de"): 1.0, ("other", "en", "src3"): 5.0}
    domain = F.when(F.col("source").isin("src0", "src1", "src2"), "web").otherwise("other")
    epochs, n = 2, lambda t: len((t or "").split())
    rows = [r.asDict() for r in docs.collect()]
    leaf = lambda r: ("web" if r["source"] in ("src0", "src1", "src2") else "other", r["lang"] or "?", r["source"] or "?")
    size = {}
    for r in rows:
        size[leaf(r)] = size.get(leaf(r), 0) + n(r["text"])

    def room(prefix):
        return epochs * sum(v for k, v in size.items() if k[: len(prefix)] == prefix)

    def give(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        children = sorted({k[: len(prefix) + 1] for k in size if k[: len(prefix)] == prefix})
        lo, hi = 0.0, 1e9  # level of water: each child takes its weight times the level, up to its room
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(min(weights.get(c, 1.0) * mid, room(c)) for c in children) < budget:
                lo = mid
            else:
                hi = mid
        out = {}
        for c in children:
            out |= give(c, min(weights.get(c, 1.0) * hi, room(c)))
        return out

    budget = give((), min(sum(size.values()), room(())))
    order = {(r["doc_id"], r["e"]): r["o"] for r in docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("e"), F.xxhash64(F.lit(42), F.col("doc_id"), F.col("text")).alias("h")).select("doc_id", "e", F.xxhash64(F.lit(42), "e", "h").alias("o")).collect()}
    got = {}
    for r in mixing.mix(docs, domain, weights, max_epochs=epochs).collect():
        got.setdefault(leaf(r.asDict()), set()).add((r["doc_id"], r["mix_epoch"]))
    mask = (1 << 64) - 1
    cells = 1 << max(0, (max(sum(leaf(r) == k for r in rows) for k in size) // mixing.CELL_ROWS).bit_length())
    for k in size:
        mine, want, left = [r for r in rows if leaf(r) == k], set(), budget[k]
        e = 0
        while size[k] and left >= size[k] - 1e-6:
            want |= {(r["doc_id"], e) for r in mine}
            left, e = left - size[k], e + 1
        place = lambda o: (((o & mask) >> 32) % cells, o)
        for r in sorted(mine, key=lambda r: place(order[r["doc_id"], e])) if left > 1e-6 else []:
            left -= n(r["text"])
            if left < -1e-6:
                break
            want.add((r["doc_id"], e))
        assert got.get(k, set()) == want, (k, budget[k], size[k])


def test_shortage_goes_to_siblings_first():
    root = mixing.tree({("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 100.0}, {("a",): 0.5, ("b",): 0.5}, 1)
    assert mixing.allocate(root, 100) == 0
    assert {n.name: round(n.budget, 6) for n in mixing.leaves(root)} == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}


def test_license_places(spark):
    mit = licenses.TEMPLATES["MIT"]
    broken = mit.replace("without restriction", "with no restriction").replace("merge, ", "")
    texts = [f"foo bar {mit} baz", f"Before. {broken}", mit[: len(mit) // 4], "nothing here", None, "", f"{licenses.TEMPLATES['MIT-line']} and {licenses.TEMPLATES['MIT-line']}"]
    rows = licenses.scan(frame(spark, texts)).collect()
    full = next(r for r in rows if r["doc_id"] == 0)
    assert full["coverage"] == 1.0 and texts[0][full["start_char"] : full["end_char"]] == mit.rstrip(".")
    assert next(r for r in rows if r["doc_id"] == 1)["coverage"] > 0.9
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 6, 6]


def test_license_places_match_brute_force(spark):
    """Brute force: at each place, the template's words that a longest common subsequence finds in a window of its length."""
    rng = random.Random(3)
    templates = {"long": " ".join(f"t{i}" for i in range(40)), "short": "alpha beta gamma delta epsilon zeta"}
    texts = []
    for _ in range(40):
        name = rng.choice(list(templates))
        words = templates[name].split()
        for _ in range(rng.randint(0, 2 if name == "long" else 0)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(f"{prose(rng, rng.randint(0, 30))} {' '.join(words)} {prose(rng, rng.randint(0, 30))}")
    texts += ["İstanbul " * 100 + templates["short"], prose(rng, 50)]

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    got = {}
    for r in licenses.scan(frame(spark, texts), templates).collect():
        t = texts[r["doc_id"]]
        assert r["coverage"] == r["matched"] / r["template_words"]
        assert common(templates[r["license"]].split(), licenses.words(t[r["start_char"] : r["end_char"]])) == r["matched"]
        got.setdefault(r["doc_id"], []).append((r["license"], r["matched"]))
    for i, t in enumerate(texts):
        words = licenses.words(t)
        want = []
        for name, template in templates.items():
            size = len(template.split())
            best = max((common(template.split(), words[k : k + size]) for k in range(len(words))), default=0)
            if best >= licenses.least_coverage(size) * size:
                want.append((name, best))
        assert got.get(i, []) == want, i


def test_of_overlapping_places_the_best_stays(spark):
    t = licenses.TEMPLATES
    rows = licenses.scan(frame(spark, [t["Apache-2.0"], t["BSD-2-Clause"], t["BSD-3-Clause"], t["GPL-2.0-notice"], t["LGPL-3.0-notice"]])).collect()
    assert sorted((r["doc_id"], r["license"]) for r in rows) == [(0, "Apache-2.0"), (1, "BSD-2-Clause"), (2, "BSD-3-Clause"), (3, "GPL-2.0-notice"), (4, "LGPL-3.0-notice")]
    assert all(r["coverage"] == 1.0 for r in rows)


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}
    calls = spark.createDataFrame(
        [("c1", "add", '{"a": 1}', [], 0), ("c2", "add", '{"b": 1}', ["c1"], 1), ("c3", "nope", "{}", ["c2", "c1"], 2), ("x", "add", '{"a":2}', ["y"], 3), ("y", "add", '{"a":3}', ["x"], 4), (None, "add", None, [], 5), ("d", "add", "{", ["zz"], 6), ("d", "add", '{"a":1}', None, 7)],
        "call_id string, name string, arguments string, depends array<string>, ord bigint",
    )
    results = spark.createDataFrame([("c1", "one", 0), ("c1", "two", 1), ("lost", "x", 0)], "call_id string, content string, ord bigint")
    got = {r["ord"]: r for r in toolcalls.link(calls, results, schema, ["ord"]).collect()}
    assert [got[i]["level"] for i in range(8)] == [0, 1, 2, None, None, 0, 0, 0]
    assert got[0]["valid"] and json.loads(got[0]["json"]) == {"arguments": {"a": 1}, "depends_on": [], "id": "c1", "level": 0, "name": "add", "result": "one"}
    assert "$.a: missing" in got[1]["errors"] and "$.b: not allowed" in got[1]["errors"] and "name: no such tool" in got[2]["errors"]
    assert "depends: cycle" in got[3]["errors"] and "id: missing" in got[5]["errors"] and "id: duplicate" in got[6]["errors"] and "arguments: not JSON" in got[6]["errors"]
    assert got[0]["json"] == toolcalls.canonical(json.loads(got[0]["json"]))
    assert [r["call_id"] for r in toolcalls.orphans(calls, results).collect()] == ["lost"]
    assert toolcalls.link(calls.limit(0), results, schema).count() == 0


def test_links_match_brute_force(spark):
    """Random calls with repeats, nulls, circles, broken arguments: levels by the longest chain, flags by looking at all."""
    rng = random.Random(12)
    schema = {"t": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}}}}
    ids = [f"c{i}" for i in range(60)]
    texts = ['{"n": 1}', '{"n": -1}', '{"m": 2}', "[]", "{", None, '{"n": NaN}', '{"n": 1e999}', '{"n":true}']
    calls = []
    for k in range(80):
        i = None if rng.random() < 0.1 else rng.choice(ids)
        deps = [rng.choice([*ids[: (ids.index(i) if i and rng.random() < 0.9 else 60)], None, "unknown"]) for _ in range(rng.randint(0, 2))]
        calls.append((i, rng.choice(["t", "t", "u"]), rng.choice(texts), None if rng.random() < 0.1 else deps, k, "kept"))
    results = [(rng.choice([*ids, None]), f"r{k}", rng.randint(0, 3)) for k in range(40)]
    df = spark.createDataFrame(calls, "call_id string, name string, arguments string, depends array<string>, ord bigint, level string")
    got = {r["ord"]: r for r in toolcalls.link(df, spark.createDataFrame(results, "call_id string, content string, ord bigint"), schema, ["ord", "level"]).collect()}
    have = [c[0] for c in calls if c[0]]
    needs = {i: {d for c in calls if c[0] == i for d in c[3] or [] if d in have} for i in have}

    def level(i, above=()):
        if i in above:
            return math.inf
        return max((1 + level(d, (*above, i)) for d in needs[i]), default=0)

    for i, name, args, deps, k, _ in calls:
        want = set()
        if i is None:
            want.add("id: missing")
        else:
            want |= {"id: duplicate"} if have.count(i) > 1 else set()
            want |= {"depends: cycle"} if level(i) == math.inf else set()
            want |= {"depends: unknown id"} if any(d is not None and d not in have for c in calls if c[0] == i for d in c[3] or []) else set()
        answers = sorted((r[2], r[1]) for r in results if i is not None and r[0] == i)
        want |= set() if answers else {"result: missing"}
        if args is None:
            want.add("arguments: missing")
        elif name == "u":
            want.add("name: no such tool")
            want |= {"arguments: not JSON"} if args in ("{", '{"n": NaN}', '{"n": 1e999}') else set()
        else:
            want |= {'{"n": -1}': {"$.n: too small"}, '{"m": 2}': {"$.n: missing"}, "[]": {"$: not object"}, '{"n":true}': {"$.n: not integer"}, '{"n": 1}': set()}.get(args, {"arguments: not JSON"})
        r = got[k]
        assert set(r["errors"]) == want and r["valid"] == (not want), (i, args, r["errors"], want)
        assert r["kept_level"] == "kept" and r["level"] == (0 if i is None else None if level(i) == math.inf else level(i))
        body = json.loads(r["json"], parse_constant=lambda x: pytest.fail(x))
        assert body["result"] == (answers[0][1] if answers else None) and body["depends_on"] == sorted(d for d in deps or [] if d is not None)


def test_chains_of_calls(spark):
    calls = spark.createDataFrame([(f"c{i}", "t", "{}", [f"c{i - 1}"] if i else [], i) for i in range(40)], "call_id string, name string, arguments string, depends array<string>, ord bigint")
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(calls).collect()} == {f"c{i}": i for i in range(1, 40)}


def test_toxicity_held_out_and_swapped(spark):
    rng = random.Random(3)
    bad, groups = ["zorgle", "blarg"], ["women", "muslims", "immigrants"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        # a group is named in toxic texts above all: what a plain classifier would learn
        named = rng.choice(groups) if rng.random() < (0.9 if toxic else 0.15) else ""
        texts.append(f"{prose(rng, 12)} {named} {rng.choice(bad) if toxic else ''}")
        labels.append((i, 1, int(toxic)))
    docs = frame(spark, [*texts, None, "", "women muslims immigrants and men"])
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.judged(docs, known).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in rows.items())
    held = [(rows[i]["predicted"], t) for i, _, t in labels if rows[i]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert rows[902]["predicted"] == 0 and rows[900]["score"] == rows[901]["score"]
    assert toxicity.judged(docs, known.limit(0)).filter("score <> 0").count() == 0
    model = toxicity.fit(docs, known)
    odd = docs.withColumn("_score", F.lit("x")).withColumn("_text", F.lit(1))
    assert toxicity.reject(odd, model).columns == odd.columns


def test_swaps_stay_within_a_kind():
    out = toxicity.swaps("The women, and gay men.")
    assert len(out) == 4 and all("women," not in x.split() and "gay" not in x.split() for x in out)
    assert {x.split()[1] for x in out} == {"men,", "girls,", "boys,"} and len({x.split()[3] for x in out}) == 4
    assert toxicity.swaps("nobody here") == []


def test_the_penalty_lowers_scores_of_neutral_mentions(spark):
    rng = random.Random(4)
    groups = ["women", "muslims", "immigrants"]
    texts, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        named = rng.choice(groups) if rng.random() < (0.9 if toxic else 0.1) else ""
        texts.append(f"{prose(rng, 12)} {named} {rng.choice(['zorgle', 'blarg']) if toxic and rng.random() < 0.7 else ''}")
        labels.append((i, 1, int(toxic)))
    neutral = [f"{prose(rng, 12)} {g}" for g in groups for _ in range(30)]
    docs = frame(spark, texts + neutral)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    mean = {}
    for fair in (0.0, 8.0):
        model = toxicity.fit(docs, known, fair=fair)
        rows = toxicity.score(docs.filter("doc_id >= 900"), model).collect()
        mean[fair] = (sum(r["score"] for r in rows) / len(rows), sum(r["score"] >= toxicity.THRESHOLD for r in rows))
    print("neutral mentions: mean score, false positives", mean)
    assert mean[8.0][0] < mean[0.0][0] - 0.05 and mean[8.0][1] <= mean[0.0][1]


def test_scores_match_brute_force(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(1, 40)) + (" zorgle" if i % 2 else "") for i in range(300)] + [None, "", "ZORGLE, Zorgle! (zorgle)"]
    docs = frame(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id bigint, quality int, toxic int"))

    def score(text):
        hit = set()
        for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            hit |= {w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)}
        z = model.bias + sum(model.weights.get(zlib.crc32(f.encode()), 0.0) for f in sorted(hit))
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    for r in toxicity.score(docs, model).collect():
        assert abs(r["score"] - score(texts[r["doc_id"]])) < 1e-9


def test_pipeline_of_odd_documents(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(rng, 40) for _ in range(60)]
    texts += [texts[0], texts[1] + " end", None, "", "x " * 5000, "Mail bob@example.com now " + prose(rng, 20)]
    frame(spark, texts, [(None, "no id", None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(6)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(rows[0].asDict())
    assert not {60, 61} & {r["doc_id"] for r in rows}
    docs = corpus_pipeline.table(spark, str(tmp_path), "documents")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "bpe":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name


def test_turns_without_a_key_are_kept_and_flagged(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", "c"), (1, None, "user", "d"), (None, None, "user", "e"), (None, 1, "assistant", "f"), (2, 5, "assistant", "g")], "conv_id long, turn int, role string, text string")
    calls, results = toolcalls.from_turns(df)
    rows = {(r["conv_id"], r["turn"]): r for r in toolcalls.link(calls, results, toolcalls.TURN_SCHEMA, ["conv_id", "turn"]).collect()}
    assert set(rows) == {(1, 0), (None, 0), (1, None), (None, None)}
    assert rows[1, 0]["valid"] and rows[1, 0]["call_id"] == "1:0"
    assert all(rows[k]["call_id"] is None and not rows[k]["valid"] and "id: missing" in rows[k]["errors"] for k in rows if k != (1, 0))
    assert sorted(r["content"] for r in toolcalls.orphans(calls, results).collect()) == ["f", "g"]


def test_no_name_is_its_own_surrogate():
    for key in (pii.KEY.encode(), b"k1", b"k2"):
        for names in pii.GIVEN:
            new = [pii._word(n, key) for n in names]
            assert sorted(new) == sorted(names) and all(a != b for a, b in zip(new, names, strict=True))
        short = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
        new = [pii._word(n, key) for n in short]
        assert len(set(new)) == len(new) and all(a != b for a, b in zip(new, short, strict=True))
