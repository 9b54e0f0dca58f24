"""Byte-level BPE by a distinct-word table of the corpus, and decoding through an id-to-piece join.

``split`` cuts every whole text into pre-token words, where it is read, and numbers them: a block (about BLOCK_CHARS of
text, or one longer text) has one row of its distinct words in the order of their hashes, and each of its texts one row
of word numbers. These rows are written once, bucketed by block, so numbers of texts are never shuffled. The blocks'
words are dealt by ranges of hashes, as many as the corpus needs for about RANGE_WORDS places each: a range holds all
places of its words, so each word is encoded once for the corpus (``coded``). A block's ids of a range go back to it as
one row, in the order in which its words went out, and block by block to the texts. A task holds a range's distinct words
or a block, however frequent a word or long the corpus. Decoding joins ids to pieces; that table has one entry an id, so its size is the vocabulary's.

A character's class (letter, number, space, other) is asked of the library's own pre-tokenizer once, so words are cut
as the library cuts them, whatever its Unicode version. Special tokens in a text are cut out first, as the library does.

Defined results: null text counts as empty (no ids, empty decoded text); null or repeated doc_id rows each give a row;
a text of any length is one row; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_chars, lean, materialise, release, shuffles, small_batches

#: Characters of text and distinct words of a block, and characters that are cut into words at once, about.
BLOCK_CHARS, BLOCK_WORDS, CHUNK_CHARS = 16_000_000, 250_000, 500_000
#: Word numbers that are turned into ids at once, and places of words (one a block and word) in a range of hashes, about.
GATHER, RANGE_WORDS = 500_000, 65_536
SPLIT = "block bigint, doc_id bigint, codes binary, words binary, sizes binary, n_words bigint"
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)


@lru_cache(1)
def _tokenizer(path: str):
    """One a process, as it takes longer to read than a small task to run."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in _tokenizer(path).get_added_tokens_decoder().items()}


class Splitter:
    """Texts to words. ``classes`` is filled as characters are met."""

    def __init__(self) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.pre = ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)

    def class_of(self, c: str) -> int:
        """That of the sign with which it makes one word; white space makes one with none."""
        return next((k for k, sign in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.pre.pre_tokenize_str(sign + c)) == 1), SPACE)

    def cuts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places where words begin, and the end; first: whether a place begins a text."""
        n = len(codes)
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            for c in np.unique(codes[kind == UNKNOWN]).tolist():
                self.classes[c] = self.class_of(chr(c))
            kind = self.classes[codes]
        new = first.copy()
        new[1:] |= kind[1:] != kind[:-1]
        a = np.flatnonzero(new)  # runs of one class within a text
        z = np.append(a[1:], n)
        k = kind[a]
        final = np.append(first, True)[z]  # ends its text
        cut = np.append(new, True)
        # a blank goes with the word after it
        led = (k != SPACE) & ~first[a] & (codes[a - 1] == 32)
        cut[a[led]], cut[a[led] - 1] = False, True
        # of several spaces before a word the last is apart, and so is one that is no blank
        apart = (k == SPACE) & ~final & (z - a > 1)
        cut[z[apart] - 1] = True
        # English short forms: an apostrophe by itself, not after a blank, with the letters after it
        short = np.flatnonzero((k == OTHER) & (z - a == 1) & (codes[a] == ord("'")) & ~led & ~final)
        short = short[k[short + 1] == LETTER]
        at, room = a[short], (z - a)[short + 1]
        one = codes[at + 1]
        two = np.where(room > 1, codes[np.minimum(at + 2, n - 1)], 0)
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        length = np.where(is_(one, "stmd"), 1, np.where((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")), 2, 0))
        cut[at[length > 0] + 1] = False
        cut[(at + 1 + length)[length > 0]] = True
        return np.flatnonzero(cut)

    def __call__(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts in order, and how many are of each."""
        whole = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if not whole:
            return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lens)
        first = np.zeros(len(codes), bool)
        first[(ends - lens)[lens > 0]] = True
        places = self.cuts(codes, first)
        width = (codes >= 0x80).astype(np.uint8) + (codes >= 0x800) + (codes >= 0x10000) + np.uint8(1)
        offsets = np.append(0, np.cumsum(width, dtype=np.int64))[places]
        words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return words, np.diff(np.searchsorted(places, np.append(0, ends)))


def _small(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _large(data: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def packed(numbers: np.ndarray) -> bytes:
    """Word numbers, compressed: those of frequent words are small, as they come early in their blocks."""
    # bytes of one weight lie together
    return _small(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(data: bytes | None) -> np.ndarray:
    raw = np.frombuffer(_large(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel() if len(raw) else np.empty(0, "<i4")


def hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _texts_of(raw: bytes, sizes: np.ndarray) -> list[str]:
    """Neighbouring parts of UTF-8, by their lengths in bytes."""
    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(raw)).to_pylist()


class _Block:
    """Distinct words and numbered texts, until it is full."""

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.chars = number, {}, 0

    def numbers(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        rows, known = self.rows, []
        for w in coded.dictionary.to_pylist():
            known.append(rows.setdefault(w, len(rows)))
        return np.array(known, np.int32)[coded.indices.to_numpy(zero_copy_only=False)] if known else np.empty(0, np.int32)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.rows) >= BLOCK_WORDS


def _pieces_of(text: str, most: int) -> Iterator[str]:
    """Parts of a long text, cut before a blank between two signs that are no spaces, where a word begins whatever is around."""
    while len(text) > most:
        m = re.compile(r"(?<=\S)(?= \S)").search(text, most)
        if m is None:
            break
        yield text[: m.start()]
        text = text[m.start() :]
    yield text


def _split(special: dict[str, int]):
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        splitter, block = Splitter(), _Block(number)

        def rows(docs: list, texts: list[str | None]) -> pa.RecordBatch:
            sections: list[str] = []
            parts: list[list[int]] = []  # of each text: numbers of its sections, and -1 - id of special tokens
            for t in texts:
                mine: list[int] = []
                for s in pattern.split(t) if pattern and t and any(x in t for x in special) else [t or ""]:
                    if s in special:
                        mine.append(-1 - special[s])
                    else:
                        for p in _pieces_of(s, CHUNK_CHARS):
                            mine.append(len(sections))
                            sections.append(p)
                parts.append(mine)
            coded: list[np.ndarray] = []
            for group in batches_by_chars(sections, CHUNK_CHARS):
                words, counts = splitter(group)
                coded += np.split(block.numbers(words), np.cumsum(counts)[:-1])
            out = [packed(np.concatenate([np.array([i], np.int32) if i < 0 else coded[i] for i in mine] or [np.empty(0, np.int32)])) for mine in parts]
            n = len(docs)
            return batch([block.number] * n, docs, out, [None] * n, [None] * n, [None] * n)

        def dictionary() -> pa.RecordBatch:
            """Words in the order of their hashes; codes has their numbers."""
            words = list(block.rows)
            order = np.argsort(hashes(words), kind="stable")
            parts = [words[k].encode() for k in order.tolist()]
            sizes = np.fromiter(map(len, parts), np.int32, len(parts))
            return batch([block.number], [None], [packed(order)], [_small(b"".join(parts))], [packed(sizes)], [len(words)])

        def batch(*columns: list) -> pa.RecordBatch:
            kinds = {"block": pa.int64(), "doc_id": pa.int64(), "codes": pa.binary(), "words": pa.binary(), "sizes": pa.binary(), "n_words": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))

        for b in batches:
            docs, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            at = 0
            for group in batches_by_chars(texts, CHUNK_CHARS):
                yield rows(docs[at : at + len(group)], group)
                at += len(group)
                block.chars += sum(len(t or "") for t in group)
                if block.full():
                    yield dictionary()
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield dictionary()

    return lean(run)


def split(docs: DataFrame, tokenizer: str) -> DataFrame:
    """SPLIT rows: for each text (block, doc_id, codes: numbers of its words, packed), for each block its words by hash and their numbers."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_split(special_tokens(tokenizer)), SPLIT)


RANGED = "range bigint, block bigint, words binary, sizes binary"
CODED = "of_block bigint, range bigint, ids binary, lens binary"


def _cut(ranges: int):
    """Blocks' words to a row for each range of hashes in which a block has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, lens in zip(*(b.column(c).to_pylist() for c in ("block", "words", "sizes")), strict=True):
                raw, sizes = _large(words), unpacked(lens)
                at = np.append(0, np.cumsum(sizes, dtype=np.int64))
                own, first = np.unique((hashes(_texts_of(raw, sizes)) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
                rows = list(zip(first.tolist(), [*first[1:].tolist(), len(sizes)], strict=True))
                cols = [[_small(raw[at[a] : at[z]]) for a, z in rows], [packed(sizes[a:z]) for a, z in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array([block] * len(own), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["range", "block", "words", "sizes"])

    return lean(run)


def _encode_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        now, known = None, {}  # of the range at hand: ids by word
        for b in batches:
            ids, lens = [], []
            for of, words, sizes in zip(*(b.column(c).to_pylist() for c in ("range", "words", "sizes")), strict=True):
                if of != now:
                    now, known = of, {}
                texts = _texts_of(_large(words), unpacked(sizes))
                new = [w for w in texts if w not in known]
                known |= zip(new, (tuple(e.ids) for e in tok.encode_batch(new, add_special_tokens=False)), strict=True)
                coded = [known[w] for w in texts]
                ids.append(packed(np.array([i for x in coded for i in x], np.int32)))
                lens.append(packed(np.fromiter(map(len, coded), np.int32, len(coded))))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("range"), pa.array(ids, pa.binary()), pa.array(lens, pa.binary())], names=["of_block", "range", "ids", "lens"])

    return lean(run)


def coded(parts: DataFrame, tokenizer: str) -> DataFrame:
    """CODED rows: the ids of split()'s blocks' words, a row for each block and range; each distinct word is encoded once."""
    blocks = parts.filter("n_words is not null").select("block", "words", "sizes", "n_words")
    places = blocks.agg(F.sum("n_words")).first()[0] or 0
    ranges = min(max(-(-places // RANGE_WORDS), 4 * shuffles(parts.sparkSession)), 2**31)
    together = blocks.select("block", "words", "sizes").mapInArrow(_cut(ranges), RANGED).repartition(F.col("range")).sortWithinPartitions("range")
    return together.mapInArrow(_encode_words(tokenizer), CODED)


def pieces(tokenizer: str) -> list[bytes]:
    """id -> bytes; ids without a piece are empty."""
    tok = _tokenizer(tokenizer)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [x for x in range(256) if x not in keep]
    byte = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(odd)}
    vocabulary = tok.get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


class _Decoder:
    def __init__(self, table: list[bytes]) -> None:
        self.table = pa.array(table, pa.large_binary())

    def __call__(self, ids: np.ndarray) -> bytes:
        """The pieces of ids, joined; parts of a text that begin anywhere may be joined again."""
        if not len(ids):
            return b""
        got = self.table.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1]
        return memoryview(got.buffers()[2])[offsets[0] : offsets[-1]].tobytes()


def _joined(digest: list[bytes] | None, with_ids: bool):
    """Texts' word numbers and a block's ids by range of hashes, to rows of texts."""

    def run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        join = lambda parts: np.concatenate([*parts, np.empty(0, "<i4")])
        words = words.sort_by("range")  # as the block's words lie
        flat, lens = (join(unpacked(x) for x in words.column(c).to_pylist()) for c in ("ids", "lens"))
        dictionary = pc.is_valid(texts.column("n_words"))
        number = join(unpacked(x) for x in texts.filter(dictionary).column("codes").to_pylist())
        texts = texts.filter(pc.invert(dictionary))
        starts, sizes = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        starts[number], sizes[number] = np.cumsum(lens, dtype=np.int64) - lens, lens
        decode = _Decoder(digest) if digest is not None else None

        def ids_of(codes: np.ndarray) -> np.ndarray:
            """Ids in order. A negative number is an id itself, less by one."""
            own = codes < 0
            number = np.where(own, 0, codes)
            lens = np.where(own, 1, sizes[number]) if len(sizes) else np.ones(len(codes), np.int64)
            begin = np.cumsum(lens) - lens
            at = np.repeat((starts[number] if len(starts) else np.zeros(len(codes), np.int64)) - begin, lens) + np.arange(int(lens.sum()))
            out = flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else np.zeros(len(at), np.int32)
            if own.any():
                out = out.copy()
                out[begin[own]] = -1 - codes[own]
            return out.astype("<u4")

        doc, n, raw, of_ids, of_text = [], [], [], [], []
        for d, codes in zip(texts.column("doc_id").to_pylist(), texts.column("codes"), strict=True):
            numbers = unpacked(codes.as_py())
            one, two, total, kept = hashlib.sha256(), Utf8Digest(), 0, []
            for k in range(0, len(numbers), GATHER):
                ids = ids_of(numbers[k : k + GATHER])
                total += len(ids)
                if with_ids:
                    kept.append(ids.tobytes())
                if decode is not None:
                    one.update(ids.tobytes())
                    two.update(decode(ids))
            doc.append(d)
            n.append(total)
            raw.append(b"".join(kept))
            of_ids.append(one.hexdigest())
            of_text.append(two.hexdigest())
        cols = {"doc_id": pa.array(doc, pa.int64()), "n_tokens": pa.array(n, pa.int64())}
        if with_ids:
            cols["ids"] = pa.array(raw, pa.binary())
        if decode is not None:
            cols |= {"ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
        return pa.table(cols)

    def lean_run(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        try:
            return run(key, texts, words)
        finally:
            release()

    return lean_run


class Utf8Digest:
    """Of the text that bytes in parts are, with the replacement character where they are none."""

    def __init__(self) -> None:
        import codecs

        self.sum, self.reader = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")

    def update(self, part: bytes) -> None:
        self.sum.update(self.reader.decode(part).encode())

    def hexdigest(self) -> str:
        self.sum.update(self.reader.decode(b"", True).encode())
        return self.sum.hexdigest()


def _encoded(docs: DataFrame, tokenizer: str, digest: list[bytes] | None, with_ids: bool) -> DataFrame:
    parts = materialise(split(docs, tokenizer), "words", "block")
    ids = coded(parts, tokenizer)
    texts = parts.select("block", "doc_id", "codes", "n_words")
    schema = "doc_id bigint, n_tokens bigint" + (", ids binary" if with_ids else "") + (", ids_sha256 string, decoded_sha256 string" if digest is not None else "")
    return texts.groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_joined(digest, with_ids), schema)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, for each whole text."""
    return _encoded(docs, tokenizer, None, True)


def _decode_batches(table: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _Decoder(table)
        for b in batches:
            texts = [decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), b.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return lean(run)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encode()'s rows with ``text``, joined from the pieces of the ids."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode_batches(pieces(tokenizer)), f"{ENCODED}, text string")


def digests(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """A row per document: number of ids, and digests of the ids and of the decoded text; the ids themselves if wanted."""
    return _encoded(docs, tokenizer, pieces(tokenizer), with_ids)
