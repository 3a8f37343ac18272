"""N-gram Jaccard join by PartEnum signatures.

Documents whose sets of distinct 5-word shingles have 100 * intersection >=
75 * union are linked; the join is exact. Sets of sizes x and y link if
their symmetric difference is at most (x + y) / 7.

Equal sets are one class, so copies cost nothing further. Sizes are cut into
bands, each 16/9 times as wide as the last; a pair meets in the band of its larger
set, so a set signs for its own band and, if a partner may be in it, the next. A band
cuts the feature domain by hash into groups, and each group into ``n2`` parts. Of two sets that differ
in at most k features, one of k div (k2 + 1) + 1 groups has at most ``k2`` differences,
so ``n2 - k2`` of its parts are the same: a set signs every subset of so many parts of
its groups (``signatures`` says which). The groups that a set signs follow from its own size, the parts from its band alone. Sets differ in no more
features of a smaller domain, so frequent features, those of passages that many documents share, are
left out of the first scheme's domain.

``SCHEMES`` lists (k2, n2), each more selective than the last. All sets sign by the first. In a
bucket all sets are first compared with the least one of those buckets that they share most, so a large group of near copies costs a link each; then,
as long as that helps, with one of those outside the bucket's largest component. What is still apart is compared one by
one in buckets with at most ``APART`` sets outside the largest component (``links.linked_classes``). The sets of other buckets
sign by the next scheme, which is complete for them by itself; after the last scheme all are
compared. No link is lost, and nothing is capped.

A task sends its signatures packed, a row a bucket of signatures, with sets that share a signature in the
task as followers of the least one: a common signature sends an entry a task to its bucket, and the followers are dealt by
their own hashes. Pairs pass parities in proportion to the sets (a lower bound of the difference) inside the join, before texts
are fetched to verify them.

A class is known by 128 bits of its set. Words are lower-cased in A-Z only. Nulls: a null text has no words,
and such documents link with nothing; a null doc_id stays null and is no component's id unless all
of its component are null. Rows with equal sets are one class, repeated rows included. Very long texts are one set
like others. Empty table: empty result. Extra columns pass through ``one_of_each``, which keeps one row of a component: that of
the least doc_id (null after all others), of these that of the least hash of the text, of identical rows any one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_bounded, discard, hot_join, stored, text_of
from .links import linked_classes

SHINGLE = 5
#: (k2, n2) of the first signatures and of those for sets that stay apart in crowded buckets.
SCHEMES = [(1, 3), (2, 5), (3, 7)]
#: Sets outside a bucket's largest component that are compared with all of the bucket at once.
APART = 64
#: Signed sets are gathered until they have so many features; of schemes with more subsets, so many fewer. Verified sets are kept up to so many.
CHUNK = 1_000_000
#: Features of all sets for one packed bucket of signatures.
BUCKET = 2_000_000
#: A SAMPLE-th of the sets tells which features are hot: in HOT_TIMES sets of it or more, marked in HOT_BITS bits (8 MB), whatever their number.
SAMPLE = 8
HOT_TIMES = 2
HOT_BITS = 1 << 26
LEAST = 4
#: Bits of the parities that are compared first.
BRIEF = 512
#: Any two sets of a bucket may be compared.
SIDE = 2
U = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ U(salt)) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = min(SHINGLE, len(words))
    out = np.full(len(words) - n + 1, n, U)
    for i in range(n):
        out = mixed(out + h[i : len(h) - n + 1 + i], i)
    return np.unique(out)


def node_of(f: np.ndarray) -> bytes:
    """The class: 128 bits of the set."""
    return b"".join(np.add.reduce(mixed(f, s)).tobytes() for s in (101, 102)) if len(f) else bytes(16)


def parities(f: np.ndarray) -> list[int]:
    """Parities in two to four bits a feature, 256 at least; two sets differ in at least as many features as parities."""
    bits = max(256, 1 << (2 * len(f) - 1).bit_length())
    odd = np.bincount((mixed(f, 103) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def brief_parities(f: np.ndarray) -> list[int]:
    """Parities in BRIEF bits, whatever the size."""
    odd = np.bincount((mixed(f, 103) & U(BRIEF - 1)).astype(np.int64), minlength=BRIEF) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def fewest_differences(x: Column, y: Column) -> Column:
    """A lower bound of the difference of two sets from their parities; the longer ones, of twice the length, are folded."""

    def fold(a: Column, n: Column) -> Column:
        half = lambda a: F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(a) > n, half(a)).otherwise(a)

    least = F.least(F.size(x), F.size(y))
    odd = F.zip_with(fold(x, least), fold(y, least), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(odd, F.lit(0), lambda s, v: s + v)


def may_link(na: Column, pa_: Column, nb: Column, pb: Column) -> Column:
    """Whether sizes and parities leave a link open. Sizes that pass differ by a third at most, so lengths by a factor of two."""
    size = (4 * na >= 3 * nb) & (4 * nb >= 3 * na)
    return F.when(size, 7 * fewest_differences(pa_, pb) <= na + nb).otherwise(F.lit(False))


def may_link_briefly(na: Column, qa: Column, nb: Column, qb: Column) -> Column:
    """The same by ``brief_parities``, without lambdas."""
    differ = sum((F.bit_count(F.get(qa, F.lit(i)).bitwiseXOR(F.get(qb, F.lit(i)))) for i in range(1, BRIEF // 64)), F.bit_count(F.get(qa, F.lit(0)).bitwiseXOR(F.get(qb, F.lit(0)))))
    return (4 * na >= 3 * nb) & (4 * nb >= 3 * na) & (7 * differ <= na + nb)


def bands(most: int) -> list[int]:
    """Largest sizes of the bands."""
    out = [4]
    while out[-1] < most:
        out.append(math.ceil(out[-1] * 16 / 9))
    return out


def signatures(sets: list[np.ndarray], scheme: int = 0, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of sets of 3 features or more; ``hot`` features (bits by ``hot_places``) are left out of the domain.

    A group is good for a set if more than k2 of its parts are not empty. A set signs, up to its last needed good group, all groups, by their
    subsets that are not empty. Of the first k div (k2 + 1) + 1 groups that are good for either set of a pair, one has at most k2 differences,
    so a part that is not empty is the same, and both sign a subset with it. A set with too few good groups also signs the prefix of its
    features, hot ones last: two such sets share one of these.
    """
    k2, n2 = SCHEMES[scheme]
    subsets = list(itertools.combinations(range(n2), n2 - k2))
    sizes = np.array([len(f) for f in sets], np.int64)
    ends = np.array(bands(int(sizes.max()) * 4 // 3))
    own = np.searchsorted(ends, sizes)
    reach = sizes * 4 // 3  # of partners
    feats, of_feat = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    common = np.zeros(len(feats), bool)
    if hot is not None:
        at = hot_places(feats)
        common = (hot[at >> 6] >> (at & 63)) & 1 == 1
    rare, of_rare = feats[~common], of_feat[~common]
    value = mixed(rare, 105)
    poor = np.zeros(len(sets), bool)
    sigs, of = [], []
    for up in (0, 1):
        take = reach > ends[own] if up else np.ones(len(sets), bool)
        band = own + up
        signs = (sizes + np.minimum(reach, ends[np.minimum(band, len(ends) - 1)])) // 7 // (k2 + 1) + 1
        groups = np.where(take, np.ceil(0.36 * ends[np.minimum(band, len(ends) - 1)] / (k2 + 1)).astype(np.int64) + 1, 0)
        base = np.cumsum(groups) - groups
        mine = take[of_rare]
        x, row = rare[mine], of_rare[mine]
        part = (mixed(x, 104 + 8 * scheme) % (groups[row] * n2).astype(U)).astype(np.int64) + base[row] * n2
        sums = np.zeros(int(groups.sum()) * n2, U)
        np.add.at(sums, part, value[mine])
        filled = (np.bincount(part, minlength=len(sums)) > 0).reshape(-1, n2)
        n_filled = filled.sum(axis=1)
        good = n_filled > k2
        of_group = np.repeat(np.arange(len(sets)), groups)
        so_far = np.cumsum(good)
        start = np.r_[0, so_far][base]
        poor |= take & (np.r_[0, so_far][base + groups] - start < signs)
        at = np.flatnonzero((so_far - good - start[of_group] < signs[of_group]) & (n_filled > 0))
        owner = of_group[at]
        place = mixed((band[owner] * (1 << 40) + at - base[owner]).astype(U), 106 + 8 * scheme)
        parts = [mixed(sums[at * n2 + j], 200 + j) for j in range(n2)]
        for i, s in enumerate(subsets):
            keep = filled[at][:, list(s)].any(axis=1)
            sigs.append(mixed(sum((parts[j] for j in s), place), 300 + i)[keep])
            of.append(owner[keep])
    ends_of = np.cumsum(sizes)
    for i in np.flatnonzero(poor):
        at = slice(ends_of[i] - sizes[i], ends_of[i])
        f = mixed(feats[at], 108)
        f = f[np.lexsort((f, common[at]))][: sizes[i] - (3 * sizes[i] + 3) // 4 + 1]
        sigs.append(f)
        of.append(np.full(len(f), i))
    return np.concatenate(sigs), np.concatenate(of)


def chunk(scheme: int) -> int:
    """Features of sets that are signed at once: memory goes with the signatures, a set of which each subset of a group's parts makes."""
    subsets = [math.comb(n2, k2) for k2, n2 in SCHEMES]
    return CHUNK * subsets[0] // subsets[scheme]


def _planes(a: np.ndarray) -> bytes:
    """Bytes by their place in the numbers, which compresses well."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _binary(a: np.ndarray) -> pa.Array:
    """16 bytes a row of an array of shape (n, 2)."""
    data = np.ascontiguousarray(a)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _list_column(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(itertools.chain.from_iterable(rows)), pa.int64()))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n, node, odd, brief, sample) per row, stored: a hash of its text, the size of its set, its class, parities, and the features of a SAMPLE-th of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            nodes = [node_of(f) for f in sets]
            columns = [
                batch.column("doc_id"),
                batch.column("copy"),
                pa.array([len(f) for f in sets], pa.int64()),
                pa.array(nodes, pa.binary()),
                _list_column([parities(f) for f in sets]),
                _list_column([brief_parities(f) for f in sets]),
                _list_column([f.view(np.int64).tolist() if node[0] % SAMPLE == 0 else [] for f, node in zip(sets, nodes, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "n", "node", "odd", "brief", "sample"])

    text = text_of(docs["text"])
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("copy"), text.alias("text"))
    return stored(d.mapInArrow(run, "doc_id long, copy binary, n long, node binary, odd array<long>, brief array<long>, sample array<long>"), "jaccard-classes")


def hot_places(f: np.ndarray) -> np.ndarray:
    return (mixed(f, 109) & U(HOT_BITS - 1)).astype(np.int64)


def hot_features(cls: DataFrame) -> np.ndarray:
    """HOT_BITS bits, packed: those of the features that HOT_TIMES sets or more of the sample have.

    Of sets that share one of their LEAST least features only the least counts, so that groups of near copies do not make their features hot. The
    bits decide which signatures are made, never which links are found; a rare feature that falls on a set bit is left out as well.
    """
    s = cls.where(F.size("sample") > 0).groupBy("node").agg(F.first("sample").alias("sample"))
    first = s.select("node", F.explode(F.slice("sample", 1, LEAST)).alias("f"))
    alone = first.join(first.groupBy("f").agg(F.min("node").alias("least")), "f").groupBy("node").agg(F.bool_and(F.col("node") == F.col("least")).alias("alone"))
    x = s.join(alone.where("alone").select("node"), "node", "left_semi").select(F.explode("sample").alias("f"))
    top = x.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_TIMES).select("f")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(hot_places(batch.column("f").to_numpy(zero_copy_only=False).astype(np.int64).view(U)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], names=["word", "bits"])

    words = top.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # HOT_BITS / 64 rows at most
    out = np.zeros(HOT_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def packed(texts: DataFrame, scheme: int, n_buckets: int, hot: np.ndarray | None) -> DataFrame:
    """(bucket, sigs, at, fsigs, fat, fcenter, nodes): signatures of a task's sets in one bucket of signatures.

    ``at`` is a set's place in ``nodes``, doubled, and odd if it has followers; the f-columns are the followers'.
    """
    names = ["bucket", "sigs", "at", "fsigs", "fat", "fcenter", "nodes"]

    def rows(sets: list[np.ndarray], nodes: list[bytes]) -> pa.RecordBatch:
        sig, of = signatures(sets, scheme, hot)
        order = np.lexsort((of, sig))
        sig, of = sig[order], of[order]
        first = np.r_[True, sig[1:] != sig[:-1]]
        at = np.flatnonzero(first)
        size = np.diff(np.r_[at, len(sig)])
        center = np.repeat(of[at], size)
        table = np.frombuffer(b"".join(nodes), U).reshape(-1, 2)
        bucket = lambda h: ((h >> U(32)) * U(n_buckets)) >> U(32)
        main = (sig[first], of[first] * 2 + (size > 1))
        fsig, fof, fcenter = sig[~first], of[~first], center[~first]
        fb = bucket(mixed(fsig ^ table[fof, 0], 400))
        order = np.argsort(fb, kind="stable")
        fsig, fof, fcenter, fb = fsig[order], fof[order], fcenter[order], fb[order]
        cut = np.searchsorted(bucket(main[0]), np.arange(n_buckets + 1, dtype=U))
        fcut = np.searchsorted(fb, np.arange(n_buckets + 1, dtype=U))
        out: list[tuple] = []
        for b in np.flatnonzero((np.diff(cut) > 0) | (np.diff(fcut) > 0)):
            m, f = slice(cut[b], cut[b + 1]), slice(fcut[b], fcut[b + 1])
            used = np.unique(np.concatenate([main[1][m] >> 1, fof[f], fcenter[f]]))
            local = lambda i: np.searchsorted(used, i)  # noqa: E731, B023
            s = main[0][m]
            out.append((
                int(b),
                _planes(np.diff(s, prepend=U(0))),
                _planes((local(main[1][m] >> 1) * 2 + (main[1][m] & 1)).astype(np.uint32)),
                _planes(fsig[f]),
                _planes(local(fof[f]).astype(np.uint32)),
                _planes(local(fcenter[f]).astype(np.uint32)),
                table[used].tobytes(),
            ))
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        nodes: list[bytes] = []
        seen: set[bytes] = set()
        held, most = 0, chunk(scheme)
        for batch in batches:
            for t in batch.column("text"):
                f = shingles(t.as_py())
                if len(f) < 3:  # links with equal sets only
                    continue
                node = node_of(f)
                if node in seen:
                    continue
                seen.add(node)
                sets.append(f)
                nodes.append(node)
                held += len(f)
                if held >= most:
                    yield rows(sets, nodes)
                    sets, nodes, held = [], [], 0
            if len(seen) > CHUNK:
                seen.clear()
        if sets:
            yield rows(sets, nodes)

    return texts.mapInArrow(run, "bucket int, sigs binary, at binary, fsigs binary, fat binary, fcenter binary, nodes binary")


def buckets(texts: DataFrame, scheme: int, features: int, hot: np.ndarray | None = None) -> DataFrame:
    """(key, node, center, side) of signatures that two sets or more have, stored. A follower's center is the least set of its task."""
    n = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(features / BUCKET))

    def run(t: pa.Table) -> pa.Table:
        sigs, flags, nodes, followers = [], [], [], []
        for r in t.to_batches():
            for sig, at, fsig, fat, fcenter, table in zip(*[r.column(c).to_pylist() for c in ("sigs", "at", "fsigs", "fat", "fcenter", "nodes")], strict=True):
                table = np.frombuffer(table, U).reshape(-1, 2)
                if sig:
                    at = _numbers(at, np.uint32)
                    sigs.append(np.cumsum(_numbers(sig, U), dtype=U))
                    flags.append((at & 1).astype(bool))
                    nodes.append(table[at >> 1])
                if fsig:
                    followers.append((_numbers(fsig, U), table[_numbers(fat, np.uint32)], table[_numbers(fcenter, np.uint32)]))
        out = [([], [], [])]
        if sigs:
            sig, flag, node = np.concatenate(sigs), np.concatenate(flags), np.concatenate(nodes)
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            same = np.r_[False, s[1:] == s[:-1]]
            keep = order[same | np.r_[same[1:], False] | flag[order]]
            sig, flag, node = sig[keep], flag[keep], node[keep]
            order = np.lexsort((node[:, 1], node[:, 0], sig))
            sig, flag, node = sig[order], flag[order], node[order]
            new_sig = np.r_[True, sig[1:] != sig[:-1]][: len(sig)]
            new = new_sig | np.r_[True, (node[1:] != node[:-1]).any(axis=1)][: len(sig)]
            # copies from other tasks fall together; a set alone stays only where a task has followers of it
            followed = np.maximum.reduceat(flag, np.flatnonzero(new)) if len(sig) else flag
            sig, node, new_sig = sig[new], node[new], new_sig[new]
            at = np.flatnonzero(new_sig)
            size = np.diff(np.r_[at, len(sig)])
            center = np.repeat(node[at], size, axis=0)
            keep = (np.repeat(size, size) > 1) | followed
            out.append((sig[keep], node[keep], center[keep]))
        out += followers
        sig, node, center = (np.concatenate([np.asarray(o[i], U).reshape(-1, *([2] if i else [])) for o in out]) for i in range(3))
        return pa.Table.from_arrays([pa.array(sig.view(np.int64)), _binary(node), _binary(center)], names=["key", "node", "center"])

    found = packed(texts, scheme, n, hot).groupBy("bucket").applyInArrow(run, "key long, node binary, center binary")
    return stored(found.withColumn("side", F.lit(SIDE)), "jaccard-buckets")


def texts_of(docs: DataFrame, cls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the classes in ``nodes``, stored; one document of a class is read. A text is smaller than its features."""
    need = nodes.select("node").distinct()
    reps = cls.join(need, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "copy")).alias("r"))
    reps = stored(reps.select("node", F.col("r.doc_id").alias("id"), F.col("r.copy").alias("c")), "jaccard-needed")
    text = text_of(docs["text"])
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumn("copy", F.unhex(F.md5("text")))
    d = d.join(broadcast_bounded(reps), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("c"))).select("node", "text")
    return stored(d.dropDuplicates(["node"]), "jaccard-texts")


def linked(pairs: DataFrame, docs: DataFrame, cls: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.75 or more, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, np.ndarray] = {}
        held = 0
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                if held > CHUNK:
                    sets.clear()
                    held = 0
                for node, column in ((a, "ta"), (b, "tb")):
                    if node not in sets:
                        sets[node] = shingles(batch.column(column)[i].as_py())
                        held += len(sets[node])
                f, g = sets[a], sets[b]
                both = len(np.intersect1d(f, g, assume_unique=True))
                keep.append(100 * both >= 75 * (len(f) + len(g) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = texts_of(docs, cls, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    x = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    x = x.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    x = stored(x.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary"), "jaccard-links")
    discard(texts)
    return x


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, (id, component) of the classes that link with another one)."""
    cls = classes(docs)
    sketch = stored(cls.where("n >= 3").groupBy("node").agg(F.first("n").alias("n"), F.first("brief").alias("brief"), F.first("odd").alias("odd")), "jaccard-sketches")

    def signed(scheme: int, crowded: DataFrame | None) -> DataFrame:
        texts, sizes = docs.select(text_of(docs["text"]).alias("text")), cls
        if crowded is not None:
            texts, sizes = texts_of(docs, cls, crowded), sketch.join(crowded, "node", "left_semi")
        features = sizes.agg(F.sum("n")).first()[0] or 0
        return buckets(texts.select("text"), scheme, features, None if scheme else hot_features(cls))

    may = lambda i, j: may_link(F.col(f"{i}.n"), F.col(f"{i}.odd"), F.col(f"{j}.n"), F.col(f"{j}.odd"))
    briefly = lambda i, j: may_link_briefly(F.col(f"{i}.n"), F.col(f"{i}.brief"), F.col(f"{j}.n"), F.col(f"{j}.brief"))
    schemes = [partial(signed, i) for i in range(len(SCHEMES))]
    return cls, linked_classes(schemes, sketch, may, lambda pairs: linked(pairs, docs, cls), APART, thin=True, brief=(["n", "brief"], briefly))


def components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, n, g, least) per row: its component, and the least doc_id of that."""
    cls, labels = labelled(docs)
    per = cls.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    per = per.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    per = stored(per.select("node", "least", F.coalesce("component", "node").alias("g")), "jaccard-nodes")
    least = per.groupBy("g").agg(F.min("least").alias("least"))
    named = hot_join(per.select("node", "g"), least, "g")
    return hot_join(cls.select("doc_id", "copy", "n", "node"), named, "node")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row."""
    return components_of(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, and all rows without words."""
    x = stored(components_of(docs), "jaccard-rows")
    key = F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "copy")
    keep = x.where("n > 0").groupBy("g").agg(F.min(key).alias("k")).select("g", F.col("k.doc_id").alias("d"), F.col("k.copy").alias("c"))
    times = x.where("n > 0").groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("times"))
    keep = keep.join(times, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("copy"))).select("d", "c", "times")
    wordless = x.where("n = 0").select(F.col("doc_id").alias("d"), F.col("copy").alias("c")).distinct()
    keep = stored(keep.union(wordless.withColumn("times", F.lit(1).cast("long"))), "jaccard-kept")
    d = docs.alias("d")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.d")) & (F.unhex(F.md5(text_of(F.col("d.text")))) == F.col("k.c"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    once = d.join(keep.where("times = 1").alias("k"), same, "left_semi").select(*columns)
    again = d.join(keep.where("times > 1").alias("k"), same, "inner").dropDuplicates(["d", "c"]).select(*columns)
    return once.unionAll(again)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return groups(table(spark, sf_dir, "documents"))
