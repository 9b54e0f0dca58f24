"""Surrogates for personal data.

Detected entities get replacements of their own type, gender, script and format. A replacement is a keyed
permutation of the entity's format: characters of each script class are digits of a mixed-radix number, which
a Feistel network of keyed hashes permutes (cycle walking keeps it in range). A permutation is its own
collision check, over all documents and without any exchange between tasks: equal entities get equal
replacements (coreference), different ones different replacements (distinctness). Listed given names are
permuted within their list, by script and gender; other names walk on until they leave the lists.
``collisions`` is the explicit check over a corpus, which the query runs too.

Names are found by a title, a phrase that introduces one, a listed given name, or an honorific after them (Hangul, Han,
kana); not by shape alone, which would take any capitalised words. Spans name an entity by a keyed digest, never by itself.

Defined results: null text stays null; texts without entities stay as they are, byte for byte; rows with null
or repeated ids are handled as any others; all columns of the input are kept, but one named as the spans, which they replace.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import lean, materialise, small_batches

KEY = "weftgraph surrogate key"  # for tests: whoever knows a key can undo the surrogates, so a job sets its own
CACHE = 20_000



def _letters(first: int, last: int) -> str:
    """Small letters that have one capital, and are its only small letter."""
    return "".join(c for c in map(chr, range(first, last + 1)) if c.islower() and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c)


def _rest(first: int, last: int, without: str) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha() and c not in without)


_SMALL = (_letters(0x61, 0x7A), _letters(0xDF, 0x17F), _letters(0x430, 0x45F), _letters(0x3AC, 0x3CE))
# Syllables and characters that are common in names; the rest of their scripts are classes of their own.
_HANGUL = "가나다라마바사아자차카타파하김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노"
_HAN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"
#: Runs of characters of one class; a character is replaced within its class.
CLASSES = (
    "0123456789", *_SMALL, *(x.upper() for x in _SMALL), _HANGUL, _rest(0xAC00, 0xD7A3, _HANGUL), _HAN, _rest(0x4E00, 0x9FA5, _HAN),
    _rest(0x3041, 0x3096, ""), _rest(0x30A1, 0x30FA, ""), _rest(0x621, 0x64A, "ـ"), _rest(0x5D0, 0x5EA, ""), _rest(0x905, 0x939, ""),
)
OF = {c: (k, i) for k, chars in enumerate(CLASSES) for i, c in enumerate(chars)}
# Given names by script and gender.
GIVEN = (
    ("james", "john", "robert", "michael", "william", "david", "thomas", "peter", "paul", "mark", "daniel", "martin", "hans", "jean", "pierre", "juan", "carlos", "luis", "pablo", "karl",
     "wei", "ahmed", "mohammed", "ali", "omar", "raj", "arjun", "hiroshi", "kenji", "minho", "piotr", "jakub", "lars", "ivan", "giovanni", "marco", "kwame", "diego", "miguel", "øystein"),
    ("mary", "anna", "linda", "susan", "sarah", "karen", "emma", "laura", "julia", "maria", "marie", "claire", "sophie", "carmen", "lucia", "elena", "petra", "ingrid", "heidi", "alice",
     "mei", "fatima", "aisha", "layla", "priya", "ananya", "yuki", "sakura", "jiwoo", "agnieszka", "zofia", "astrid", "giulia", "chiara", "amara", "sofia", "isabel", "olga", "natalia", "chloé"),
    ("иван", "пётр", "сергей", "алексей", "дмитрий", "николай", "андрей", "михаил"),
    ("анна", "мария", "елена", "ольга", "наталья", "татьяна", "ирина", "светлана"),
)
LISTED = {n: g for g in GIVEN for n in g}
# Titles; phrases that introduce a whole name; honorifics after one, and what Korean puts after these.
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña|Господин|Госпожа"
INTRODUCED = ("name is", "name:", "named", "signed by", "signed,", "regards,", "sincerely,", "heiße", "m'appelle", "me llamo", "меня зовут")
FAR_TITLES = ("السيد", "السيدة", "الدكتور", "الدكتورة", "גברת")
AFTER_HANGUL, AFTER_HAN, AFTER_KANA = ("씨", "님", "선생님", "교수님"), ("先生", "女士", "小姐", "教授"), ("さん", "様")
PARTICLES = "가|는|은|이|를|을|의|와|과|도|에게|께서|께|로"
_CAPITAL = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
_NAME = rf"[^\W\d_]*[{_CAPITAL}][^\W\d_]+"
_GIVENS = "|".join(sorted({n.capitalize() for g in GIVEN for n in g}, key=len, reverse=True))
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])"), "@"),
    ("secret", re.compile(r"(?i:(?:password|passwd|pwd|token|secret|api[_-]?key)\s*[:=]\s*[\"']?)([A-Za-z0-9+/_-]{8,})"), None),
    ("secret", re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b"), None),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "-"),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"), "."),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])"), None),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"), None),
    ("name", re.compile(rf"\b(?:{TITLES})\b\.?\s+({_NAME}(?:[ -]{_NAME}){{0,2}})"), None),
    ("name", re.compile(rf"\b((?:{_GIVENS}) {_NAME})"), None),
    ("name", re.compile(rf"(?i:{'|'.join(map(re.escape, INTRODUCED))})\s+({_NAME}(?: {_NAME}){{1,2}})"), None),
    ("name", re.compile(rf"(?:{'|'.join(FAR_TITLES)})\s+([ء-ي]+(?: [ء-ي]+)?|[א-ת]+(?: [א-ת]+)?)"), None),
    ("name", re.compile(rf"(?<![가-힣])([가-힣]{{2,4}}?)(?= ?(?:{'|'.join(AFTER_HANGUL)})(?:{PARTICLES})?(?![가-힣]))"), None),
    ("name", re.compile(rf"(?<![一-龥])([一-龥]{{2,4}}?)(?=(?:{'|'.join(AFTER_HAN)}))"), None),
    ("name", re.compile(rf"(?<![一-龥ぁ-ゖァ-ヺ])([一-龥ぁ-ゖァ-ヺ]{{2,6}}?)(?=(?:{'|'.join(AFTER_KANA)}))"), None),
)
#: Cheap tests that decide for most texts; every match of a type's pattern passes its type's test.
_DIGITS = re.compile(r"\d[ .()-]{0,2}\d[ .()-]{0,2}\d[ .()-]{0,2}\d")
_SECRET = ("passw", "pwd", "token", "secret", "api", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
_WORDS = frozenset(x + dot for x in TITLES.split("|") for dot in ("", ".")) | frozenset(n.capitalize() for g in GIVEN for n in g)
_FAR = (*FAR_TITLES, *AFTER_HANGUL, *AFTER_HAN, *AFTER_KANA)
_OPEN = re.compile(rf"[^\w\s](?:{TITLES}|{_GIVENS})\b")


def _may_hold(text: str) -> set[str]:
    kinds = set()
    if "@" in text:
        kinds.add("email")
    if _DIGITS.search(text):
        kinds |= {"iban", "ssn", "ip", "card", "phone"}
    low = text.lower()
    if any(x in low for x in _SECRET):
        kinds.add("secret")
    introduced = any(x in low for x in INTRODUCED) or not (text.isascii() or not any(x in text for x in _FAR))
    if introduced or not _WORDS.isdisjoint(text.split()) or _OPEN.search(text):
        kinds.add("name")
    return kinds


def _round(key: bytes, tweak: str, i: int, half: int, size: int) -> int:
    d = hmac.new(key, f"{tweak}|{i}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(d + hashlib.sha256(d).digest() * (size // 256 + 1), "big") & ((1 << size) - 1)


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n) in one circle, so that none stays itself if n > 1: the next in the order of a balanced Feistel network, walked into range."""
    if n <= 1:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, tweak = (1 << half) - 1, f"{tweak}|{n}"
    while True:
        a, b = x >> half, x & mask
        for i in range(8):
            a, b = b, a ^ _round(key, tweak, i, b, half)
        x = a << half | b
        if x < n:
            break
    x = (x + 1) % n
    while True:
        a, b = x >> half, x & mask
        for i in reversed(range(8)):
            a, b = b ^ _round(key, tweak, i, a, half), a
        x = a << half | b
        if x < n:
            return x


def reformat(s: str, key: bytes, tweak: str, keep: int = 0) -> str:
    """Permutes what stands in CLASSES, after ``keep`` characters; the rest, lengths and classes stay."""
    at = [(i, *OF[c]) for i, c in enumerate(s) if i >= keep and c in OF]
    x, n = 0, 1
    for _, k, v in at:
        x, n = x * len(CLASSES[k]) + v, n * len(CLASSES[k])
    x = permute(x, n, key, f"{tweak}|{''.join(chr(65 + k) for _, k, _ in at)}")
    out = list(s)
    for i, k, _ in reversed(at):
        x, v = divmod(x, len(CLASSES[k]))
        out[i] = CLASSES[k][v]
    return "".join(out)


def _secret(s: str, key: bytes) -> str:
    if re.fullmatch(r"[0-9a-f]+", s):
        n = 16 ** len(s)
        return f"{permute(int(s, 16), n, key, 'hex'):0{len(s)}x}"
    return reformat(s, key, "secret", 4 if s[:4] in ("AKIA", "ASIA") else 0)


def luhn(digits: str) -> int:
    """The check digit that ends ``digits``."""
    return -sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _spread(shape: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _card(s: str, key: bytes) -> str:
    d = "".join(c for c in s if c.isdigit())
    if luhn(d[:-1]) != int(d[-1]):
        # stays invalid: among invalid numbers, walk on while the result would be valid
        out = d
        while True:
            out = reformat(out, key, "card-odd", 1)
            if luhn(out[:-1]) != int(out[-1]):
                return _spread(s, out)
    body = reformat(d[:-1], key, "card", 1)
    return _spread(s, body + str(luhn(body)))


def _iban(s: str, key: bytes) -> str:
    d = "".join(c for c in s if c.isalnum())
    body = reformat(d[4:], key, f"iban{d[:2]}")
    code = "".join(str(int(c, 36)) for c in body + d[:2])
    valid = int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 == 1
    check = f"{98 - int(code + '00') % 97:02d}" if valid else d[2:4]
    return _spread(s, d[:2] + check + body)


def _ip(s: str, key: bytes) -> str:
    x = 0
    for p in s.split("."):
        x = x << 8 | int(p)
    x = permute(x, 1 << 32, key, "ip")
    return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))


def _phone(s: str, key: bytes) -> str:
    m = re.match(r"\+\d{1,3}(?=\D)|\+\d{2}", s)
    return reformat(s, key, "phone", m.end() if m else 0)


def _email(s: str, key: bytes) -> str:
    local, _, host = s.rpartition("@")
    name, dot, top = host.rpartition(".")
    out = reformat(f"{local.lower()}@{name.lower()}", key, f"email{top.lower()}") + dot + top
    return out


def _word(low: str, key: bytes) -> str:
    if low in LISTED:
        g = LISTED[low]
        return g[permute(g.index(low), len(g), key, f"given{g[0]}")]
    new = reformat(low, key, "name")
    while new in LISTED:
        new = reformat(new, key, "name")
    return new


def _each(s: str, change: Callable[[str], str]) -> str:
    """Letter by letter, but those of which two would come."""
    return "".join(x if len(x := change(c)) == 1 else c for c in s)


def _name(s: str, key: bytes) -> str:
    return re.sub(r"[^\W\d_]+", lambda m: _cased(m[0], key), s)


def _cased(w: str, key: bytes) -> str:
    new = _word(_each(w, str.lower), key)
    if len(w) > 1 and w.isupper():
        return _each(new, str.upper)
    return _each(new[:1], str.upper) + new[1:] if w[:1].isupper() else new


MAKERS: dict[str, Callable[[str, bytes], str]] = {
    "email": _email, "secret": _secret, "iban": _iban,
    "ssn": lambda s, k: reformat(s, k, "ssn"), "ip": _ip, "card": _card, "phone": _phone, "name": _name,
}


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of entities, without overlap: the earlier pattern wins."""
    kinds = _may_hold(text)
    if not kinds:
        return []
    out: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, pattern, sign in PATTERNS:
        if kind not in kinds or (sign and sign not in text):
            continue
        found = []
        for m in pattern.finditer(text):
            a, z = m.span(m.re.groups)
            found.append((a, z, kind))
        if found and taken:
            cut = sorted(taken)
            keep, j = [], 0
            for a, z, k in found:
                while j < len(cut) and cut[j][1] <= a:
                    j += 1
                if j == len(cut) or cut[j][0] >= z:
                    keep.append((a, z, k))
            found = keep
        out += found
        taken += [(a, z) for a, z, _ in found]
    return sorted(out)


def canonical(kind: str, s: str) -> str:
    """The spelling in which mentions of one entity agree."""
    return _each(s, str.lower) if kind in ("email", "name") else s


def entity(kind: str, s: str, key: bytes) -> str:
    """What stands for an entity where it must not be named."""
    return hmac.new(key, f"entity|{kind}|{canonical(kind, s)}".encode(), hashlib.sha256).hexdigest()[:32]


def surrogate(kind: str, s: str, key: bytes) -> str:
    return MAKERS[kind](s, key)


def replace(text: str, key: bytes, make: Callable[[str, str, bytes], str] = surrogate) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, type, original, surrogate) by positions in the original."""
    out, last, spans = [], 0, []
    for a, z, kind in find(text):
        new = make(kind, text[a:z], key)
        out += [text[last:a], new]
        spans.append((a, z, kind, text[a:z], new))
        last = z
    return ("".join([*out, text[last:]]) if spans else text), spans


def _batches(key: str, schema: StructType, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lru_cache(CACHE)(surrogate)
        for b in batches:
            at = b.schema.names.index("text")
            texts, spans = [], []
            for t in b.column(at).to_pylist():
                new, found = replace(t, key.encode(), make) if t else (t, [])
                texts.append(new)
                spans.append(([{"start": a, "end": z, "type": k, "entity": entity(k, o, key.encode()), "surrogate": n} for a, z, k, o, n in found] if with_spans else []))
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i, n in enumerate(b.schema.names)]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("type", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())]))
                cols.append(pa.array(spans, kind))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return run


SPANS = ArrayType(StructType().add("start", LongType()).add("end", LongType()).add("type", StringType()).add("entity", StringType()).add("surrogate", StringType()))


def anonymise(docs: DataFrame, key: str = KEY, spans: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; with ``spans``, a column of that name lists what was replaced: places in the original
    text, types, keyed digests of the entities and their surrogates."""
    small_batches(docs.sparkSession)
    docs = docs.drop(spans) if spans else docs
    schema = StructType([StructType().add("text", StringType()).fields[0] if f.name == "text" else f for f in docs.schema.fields])
    if spans:
        schema = schema.add(spans, SPANS)
    return docs.mapInArrow(lean(_batches(key, schema, bool(spans))), schema)


def collisions(anonymised: DataFrame, spans: str) -> DataFrame:
    """(type, surrogate, entities) where different entities met in one surrogate: none, unless a rule is broken."""
    low = F.when(F.col("e.type").isin("email", "name"), F.lower("e.surrogate")).otherwise(F.col("e.surrogate"))
    e = anonymised.select(F.explode(spans).alias("e")).select("e.type", "e.entity", low.alias("surrogate")).distinct()
    return e.groupBy("type", "surrogate").agg(F.count("*").alias("entities")).filter("entities > 1")


def checked(docs: DataFrame, key: str = KEY, spans: str = "entities") -> DataFrame:
    """anonymise(), written, once collisions() has found none in it."""
    out = materialise(anonymise(docs, key, spans), "anonymised")
    met = collisions(out, spans).limit(1).count()
    if met:
        raise RuntimeError("different entities met in one surrogate")
    return out
