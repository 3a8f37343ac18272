"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored by context windows.

``fit`` learns from labelled documents that are not held out: a lexicon of
word stems whose presence marks the label, and a logistic model over a few
counts. It reads a sample of at most about ``MAX_FIT`` labelled rows, chosen
by a hash of doc_id. The lexicon has at most ``MAX_TERMS`` stems.

``score`` looks every distinct word of a batch up once: a word that begins
with a stem is an exact hit; a stem of ``FUZZY_FROM`` letters or more also
hits words within one edit, found by walking the trie with the states of the
word's Levenshtein automaton. A hit whose window of ``WINDOW`` characters has
quotation marks on both sides, or a word of saying before it, counts as
quoted, any other as abuse.

A null or empty text has no hits and gets the model's base score. A null
doc_id is not held out. Labels, lang, source and doc_id are no inputs of a score. Empty tables:
no rows; without labelled rows of both kinds nothing is toxic. Repeated rows are scored
one by one; repeated labels count once each; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

MAX_FIT = 20_000
STEM = range(4, 8)
FUZZY_FROM = 5
WINDOW = 40
THRESHOLD = 0.7
WORDS = re.compile(r"\w+")
QUOTES = "\"'«»“”„‘’"
SAYING = re.compile(r"\b(?:said|says|wrote|quoted?|called|sagte|schrieb|dijo|escribió|dit|écrit)\W*$", re.I)
CACHE = 1_000_000


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def stems_of(words: set[str]) -> set[str]:
    """Beginnings of the words, and the words themselves with an end mark."""
    out = {w + "$" for w in words if len(w) >= STEM[0]}
    for w in words:
        out.update(w[:n] for n in STEM if len(w) >= n)
    return out


def build_trie(terms) -> dict:
    root: dict = {}
    for term in terms:
        at = root
        for c in term.removesuffix("$"):
            at = at.setdefault(c, {})
        at["$" if term.endswith("$") else "*"] = term
    return root


def begins(word: str, trie: dict) -> str | None:
    """The stem that the word begins with, or is."""
    at = trie
    for c in word:
        at = at.get(c)
        if at is None:
            return None
        if "*" in at:
            return at["*"]
    return at.get("$")


def near(word: str, trie: dict, most: int = 1) -> str | None:
    """A term within ``most`` edits of the word (of a beginning of it for stems): the automaton's states go down the trie."""
    first = tuple(range(len(word) + 1))
    stack = [(trie, first)]
    while stack:
        at, row = stack.pop()
        for c, below in at.items():
            if c == "$":
                if row[-1] <= most:
                    return below
            elif c == "*":
                if min(row[max(0, len(below) - most) :], default=most + 1) <= most:
                    return below
            else:
                new = [row[0] + 1]
                for i, x in enumerate(word):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
                if min(new) <= most:
                    stack.append((below, tuple(new)))
    return None


class Lexicon:
    """Looks words up; results are kept for the words seen last."""

    def __init__(self, terms: list[str]):
        self.exact = build_trie(terms)
        long = [t for t in terms if len(t.removesuffix("$")) >= FUZZY_FROM]
        self.fuzzy = build_trie(long)
        # within one edit, the first or the second half of a term is there unchanged
        halves = [(t.removesuffix("$"), len(t.removesuffix("$")) // 2) for t in long]
        self.heads, self.tails = {t[:h] for t, h in halves}, {t[h:] for t, h in halves}
        self.head_sizes = sorted({len(x) for x in self.heads})
        # an edit in the first half moves the second one by one place at most
        self.tail_places = sorted({(h + d, len(t) - h) for t, h in halves for d in (-1, 0, 1)})
        self.seen: dict[str, int] = {}

    def maybe(self, w: str) -> bool:
        if any(w[:n] in self.heads for n in self.head_sizes):
            return True
        return any(w[a : a + n] in self.tails for a, n in self.tail_places)

    def kind(self, w: str) -> int:
        """0: none, 1: exact, 2: within one edit."""
        k = self.seen.get(w)
        if k is None:
            if begins(w, self.exact):
                k = 1
            elif len(w) >= FUZZY_FROM - 1 and self.maybe(w) and near(w, self.fuzzy):
                k = 2
            else:
                k = 0
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[w] = k
        return k

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: abusive, quoted and misspelled hits (logarithms), share of hits, any abusive or misspelled one."""
        out = np.zeros((len(texts), 5))
        split = [WORDS.findall(t.lower()) for t in texts]
        hits = {w for w in set().union(*split) if self.kind(w)} if split else set()
        for i, words in enumerate(split):
            if hits.isdisjoint(words):
                continue
            plain = quoted = fuzzy = 0
            for m in WORDS.finditer(texts[i]):
                w = m.group().lower()
                if w in hits:
                    before, after = texts[i][max(0, m.start() - WINDOW) : m.start()], texts[i][m.end() : m.end() + WINDOW]
                    marks = sum(c in QUOTES for c in before) % 2 == 1 and any(c in QUOTES for c in after)
                    if marks or SAYING.search(before):
                        quoted += 1
                    elif self.kind(w) == 1:
                        plain += 1
                    else:
                        fuzzy += 1
            out[i] = math.log1p(plain), math.log1p(quoted), math.log1p(fuzzy), (plain + fuzzy) / len(words), plain + fuzzy > 0
        return out


def sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT) -> DataFrame:
    """(text, toxic) of labelled documents that are not held out; about ``bound`` rows if there are more."""
    usable = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    usable = usable.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    n = usable.count()
    if n > bound:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    d = docs.select(docs["doc_id"].alias("doc_id"), text_of(docs["text"]).alias("text"))
    # about ``bound`` ids, so they are broadcast and no text is shuffled
    return stored(d.join(F.broadcast(usable), "doc_id").select("text", "toxic"), "toxicity-sample")


def learn_terms(rows: DataFrame) -> list[str]:
    """Stems that occur in toxic documents and (nearly) never in others.

    Equal texts of one label count once. A stem must stand between many different pairs of words, so words that
    near copies merely happen to share are left out. No stem begins with another.
    """
    rows = stored(rows.dropDuplicates(["text", "toxic"]), "toxicity-texts")

    def count(batches: Iterator[pd.DataFrame], only: frozenset[str] | None) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for text in pdf["text"]:
                stems = stems_of(set(WORDS.findall(text.lower())))
                seen.update(stems if only is None else only.intersection(stems))
            yield pd.DataFrame({"stem": list(seen), "n": list(seen.values())})

    total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("toxic")).first()
    if not total[0] or total[0] == total[1]:
        return []
    least = max(4, math.ceil(0.004 * total[0]))
    # stems of enough toxic documents; the sample bounds them, and only they are counted in the others
    found = rows.where("toxic = 1").mapInPandas(lambda b: count(b, None), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    toxic_in = {r["stem"]: r["n"] for r in found.where(F.col("n") >= least).collect()}
    names = frozenset(toxic_in)
    others = rows.where("toxic = 0").mapInPandas(lambda b: count(b, names), "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))
    clean_in = {r["stem"]: r["n"] for r in others.collect()}
    good = [s for s, n in toxic_in.items() if 33 * clean_in.get(s, 0) <= n]
    place = {s: i for i, s in enumerate(good)}

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: set[tuple[int, int]] = set()
            for text in pdf["text"]:
                words = ["", *WORDS.findall(text.lower()), ""]
                for i, w in enumerate(words):
                    for s in stems_of({w}) if w else ():
                        if s in place:
                            seen.add((place[s], zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())))
            yield pd.DataFrame(list(seen), columns=["stem", "context"])

    # stems that copies and shared passages repeat have few contexts
    at = rows.where("toxic = 1").mapInPandas(contexts, "stem int, context long").distinct().groupBy("stem").count()
    wide = {good[r["stem"]]: r["count"] for r in at.where(F.col("count") >= least).collect()}  # a row a candidate at most
    toxic = {s: toxic_in[s] for s in good if wide.get(s, 0) >= max(least, 0.5 * toxic_in[s])}
    terms: list[str] = []
    for s in sorted(toxic, key=lambda s: (len(s), s)):
        if not any(s[:n] in terms for n in STEM if n < len(s)):
            terms.append(s)
    return sorted(terms)  # as many as the sample has; it bounds them


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the intercept last, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_FIT) -> tuple[list[str], list[float]]:
    """(lexicon, weights)."""
    rows = sample(docs, labels, bound)
    terms = learn_terms(rows)
    lexicon = Lexicon(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pd.DataFrame(lexicon.features(list(pdf["text"])), columns=list("abcde"))
            f["y"] = pdf["toxic"].to_numpy()
            yield f.groupby(list("abcdey"), as_index=False).size().rename(columns={"size": "n"})

    if not terms:
        return [], [0.0] * 5 + [-5.0]
    schema = ", ".join(f"{c} double" for c in "abcde") + ", y int, n long"
    got = rows.mapInPandas(count, schema).toPandas()  # at most the sample's rows
    x = np.repeat(got[list("abcde")].to_numpy(), got["n"], axis=0)
    return terms, logistic(x, np.repeat(got["y"].to_numpy(), got["n"])).tolist()


def score(docs: DataFrame, model: tuple[list[str], list[float]]) -> DataFrame:
    """(doc_id, score) per row."""
    terms, weights = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = Lexicon(terms), np.array(weights)
        for batch in batches:  # ids stay Arrow integers, nulls and all
            z = lexicon.features(batch.column("text").to_pylist()) @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs["text"]).alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
