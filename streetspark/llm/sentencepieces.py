"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch that are not known yet are joined into one text, whose suffixes
are sorted, by as many characters as the longest piece has, which is all that a search for pieces can ask. Every piece is looked up by binary
search, which gives the range of its occurrences; these are edges of a lattice. Sorted by
position they are relaxed from left to right: for a BPE model the encoding
of a prefix ends with exactly one piece, the one whose pair with the last piece before it
is itself encoded as these two pieces. The ids are those of the library.

Spaces stand for U+2581, one is put before the text, and characters that no piece has
become their UTF-8 bytes. Words (which start at U+2581) are encoded once a batch and kept in a bounded
cache. The model's bytes come from a path on the driver and travel with the
task, so executors need no file. Tokenizers are not trained here.

Models of other kinds, or with a normaliser, are an error. Null and empty texts have no ids; very long texts are encoded alone. Decoding gives the text back, except that U+2581 itself
becomes a space, as in the library. Repeated rows are encoded one by one; an empty table stays empty;
extra columns pass through ``encoded``.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import fresh, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE = 300_000
BATCH = 2_000_000
#: Characters of new words that are sorted at once.
CHUNK = 150_000
#: Bytes of text that are encoded at once.
SLICE = 2_000_000
_CODECS: dict[str, Codec] = {}


def fields(message: bytes) -> dict[int, int | bytes]:
    """The fields of a protocol buffer by number, the last of repeated ones: numbers, or the bytes of the rest."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            out[tag >> 3] = number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        out[tag >> 3] = message[at : at + size]
        at += size
    return out


def check_model(model: bytes) -> None:
    """An error unless the model merges pairs and takes texts as they are, with a space put before."""
    proto = fields(model)
    trainer, normalizer = fields(proto.get(2, b"")), fields(proto.get(3, b""))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model is not a BPE model")
    if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model normalises texts in a way that is not supported")


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        byte = [sp.is_byte(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if byte[i]}
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.out = [bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        # words can be cut where no piece crosses
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        cut = rf"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (r"|\n" if line else "")
        self.words = re.compile(r"(?s).+" if crossing else cut)
        # a piece that merging never makes is no edge
        names = sorted(p for p in self.ids if self.merged(p) == [p])
        self.numbers = np.array([self.ids[p] for p in names])
        self.size = [len(p) for p in self.pieces]
        self.width = max(map(len, names))
        self.lengths = np.array([len(p) for p in names])
        self.low = np.array([p.encode("utf-32-be") for p in names], f"S{4 * self.width}")
        pad = b"\x7f\xff\xff\xff" * self.width
        self.high = np.array([(p.encode("utf-32-be") + pad)[: 4 * self.width] for p in names], f"S{4 * self.width}")
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short string by merging: the best score first, then the leftmost."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (s := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[s], i, j, s))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, s = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != s:
                continue
            parts[i], parts[j] = s, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces stay two when they stand side by side."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        x, y = self.pieces[left], self.pieces[right]
        ok = self.pairs[left * len(self.pieces) + right] = self.merged(x + y) == [x, y]
        return ok

    def edges(self, text: str) -> tuple[list[int], list[int]]:
        """(end, piece) of all occurrences of pieces, by end."""
        w = self.width
        code = np.frombuffer((text + "\0" * w).encode("utf-32-be"), np.uint8).reshape(-1, 4)
        view = np.lib.stride_tricks.sliding_window_view(code, (w, 4))[: len(text), 0]
        keys = np.ascontiguousarray(view).reshape(len(text), 4 * w).view(f"S{4 * w}").ravel()
        suffixes = np.argsort(keys, kind="stable")
        keys = keys[suffixes]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        end = suffixes[at] + self.lengths[which]
        order = np.argsort(end, kind="stable")
        return end[order].tolist(), self.numbers[which[order]].tolist()

    def relax(self, words: list[str]) -> None:
        """Encodes the words, which go to the cache."""
        text = "\0".join(words)
        # the last piece of the encoding up to a place; -1: a word starts here, -2: a character without a piece
        last: list[int | None] = [None] * (len(text) + 1)
        for at, c in enumerate(text):
            if c not in self.ids:
                last[at + 1] = -1 if c == "\0" else -2  # one without a piece merges with nothing
        last[0] = -1
        size, pairs, n, fits = self.size, self.pairs, len(self.pieces), self.fits
        for at, p in zip(*self.edges(text), strict=True):
            if last[at] is None:
                b = last[at - size[p]]
                if b is not None:
                    ok = True if b < 0 else pairs.get(b * n + p)
                    if ok or (ok is None and fits(b, p)):
                        last[at] = p
        start = 0
        for word in words:
            at = start + len(word)
            out: list[int] = []
            while at > start:
                p = last[at]
                if p < 0:
                    out += [self.byte_ids.get(x, 0) for x in reversed(text[at - 1].encode("utf-8", "surrogatepass"))]
                    at -= 1
                else:
                    out.append(p)
                    at -= size[p]
            self.cache[word] = array("i", out[::-1]).tobytes()
            start += len(word) + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; words of about BATCH characters are held at a time."""
        out: list[np.ndarray] = []
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= BATCH:
                out += self.encode_part(part)
                part, size = [], 0
        return out + self.encode_part(part)

    def encode_part(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        split = [self.words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new: list[str] = []
        size = 0
        for w in set().union(*split).difference(cache) if split else ():
            if "\0" in w:  # the separator itself
                parts = [p for p in re.split("(\0)", w) if p]
                for p in parts:
                    if p != "\0" and p not in cache:
                        self.relax([p])
                nul = array("i", [self.byte_ids.get(0, 0)]).tobytes()
                cache[w] = b"".join([nul if p == "\0" else cache[p] for p in parts])
                continue
            new.append(w)
            size += len(w) + 1
            if size >= CHUNK:
                self.relax(new)
                new, size = [], 0
        if new:
            self.relax(new)
        return [np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids) -> str:
        s = b"".join([self.out[i] for i in ids if i not in self.control]).decode("utf-8", "replace")
        return s[1:] if s.startswith(" ") else s


def codec(model: bytes) -> Codec:
    """One a Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE bytes of text, so that memory does not follow rows; a very long text is alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens`` (under free names)."""
    model = read_model(path)
    check_model(model)
    text, ids, n = fresh(docs, "text_", "token_ids", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in slices(batch, text):
                found = c.encode(part.column(text).to_pylist())
                sizes = np.array([len(x) for x in found], np.int64)
                ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                rows = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))
                own = [part.column(i) for i, name in enumerate(part.schema.names) if name != text]
                yield pa.RecordBatch.from_arrays([*own, rows, pa.array(sizes)], names=[*(x for x in part.schema.names if x != text), ids, n])

    schema = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(n, LongType())])
    return docs.withColumn(text, text_of(docs["text"])).mapInArrow(run, schema)


def decoded(tokens: DataFrame, ids: str = "token_ids", name: str = "decoded", path: str = MODEL) -> DataFrame:
    """``tokens`` with the texts of the ids, under a free name; null ids give null."""
    model = read_model(path)
    (out,) = fresh(tokens, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(out, StringType())]))


def op2(spark, sf_dir: str) -> DataFrame:
    """Per document: number of tokens, SHA-256 of the ids (little-endian int32), whether decoding gives the text back."""
    from .common import table

    model = read_model()
    check_model(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = c.encode(texts)
                columns = [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([c.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    docs = table(spark, sf_dir, "documents")
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
