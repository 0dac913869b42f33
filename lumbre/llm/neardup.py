"""Near-duplicate texts by signature trees over word shingles.

Every distinct text becomes the set of its word shingles (64-bit hashes). Texts whose min-hashes agree in a band meet in
a group; the groups travel as packed arrays, each text with a token bitmap and its set size. Within a group a signature
tree holds OR-combined bitmaps and size ranges, and a dual traversal drops node pairs whose greatest possible overlap
cannot reach the threshold; texts whose sketches (one bit per min-hash) differ too much are dropped as well. What is left is
compared exactly. The bounds of the trees are exact; the sketches lose a pair at the threshold with probability 0.00003, and
the meeting in a band is probabilistic: a pair exactly at the threshold is missed with probability 0.001; at threshold 0.5 a pair at 0.55 with 0.00004,
one at 0.6 with 0.0000004, and at threshold 0.8 one at 0.85 with 0.000006.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lumbre.operators.components import components
from lumbre.sources.store import materialize

WORD = re.compile(r"[^\W_]+")
#: 64-bit words of a token bitmap, and of a sketch of one bit per min-hash.
SIGNATURE, SKETCH = 4, 3
WIDTH = SIGNATURE + SKETCH
#: Chance that a pair exactly at the threshold shares no band.
MISS = 0.001
#: Bytes of a shingle's hash that are compared in the end.
TOKEN = 6
#: Parts of a bucket's keys that are gone through one after the other.
KEY_PARTS = 8
#: Texts in a leaf of a signature tree, and children of a node.
LEAF = 4
FAN = 8
#: Groups of so many texts are searched once, however many bands they meet in.
LARGE = 64
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shape(threshold: float) -> tuple[int, int]:
    """Rows and number of bands, the same at every size of the collection; the trees prune what meets by chance."""
    rows = min(8, max(2, round(math.log(16) / math.log(1 / min(threshold, 0.99)))))
    return rows, math.ceil(math.log(MISS) / math.log(1 - threshold**rows))


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_arrays(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of the texts one after the other, and how many each text has (repeats included)."""
    get = _WORDS.__getitem__
    parts, counts = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        counts.append(max(0, len(words) - n + 1))
    lengths = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    total = len(flat) - n + 1
    counts = np.array(counts, np.int64)
    if total <= 0:
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        h = np.zeros(total, np.uint64)
        for i in range(n):
            h = (h ^ flat[i : i + total]) * np.uint64(_MULTIPLIERS[i % len(_MULTIPLIERS)])
            h ^= h >> np.uint64(29)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keep = np.arange(total) < np.repeat(start + counts, lengths)[:total]
    return h[keep], counts


def shingle_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat, counts = shingle_arrays(texts, n)
    return [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])] if len(counts) else []


def min_hashes(flat: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """``k`` min-hashes (rows) of each segment (columns)."""
    x = (flat >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, k, dtype=np.uint32)
    out = np.empty((k, len(starts)), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(k):
            out[i] = np.minimum.reduceat((x ^ shifts[i]) * factors[i], starts)
    return out


def bitmaps(flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    bits = SIGNATURE * 64
    position = (flat & np.uint64(0xFFFFFFFF)) % np.uint64(bits)
    grid = np.zeros((n, bits), np.bool_)
    grid[owner, position.astype(np.int64)] = True
    return np.packbits(grid, axis=1).view(np.uint64)


def sketches(mins: np.ndarray) -> np.ndarray:
    """One bit of each of the first min-hashes of every text (columns of ``mins``)."""
    with np.errstate(over="ignore"):
        bit = (mins[: SKETCH * 64] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.ascontiguousarray(np.packbits(bit.T.astype(np.uint8), axis=1)).view(np.uint64)


def agreeing(threshold: float) -> int:
    """Sketch bits that texts at the threshold share at least, but for four standard deviations (a chance of 0.00003)."""
    m, p = SKETCH * 64, (1 + threshold) / 2
    return math.floor(m * p - 4 * math.sqrt(m * p * (1 - p)))


def _packets(shingle: int, rows: int, bands: int, buckets: int):
    """Texts to rows (bucket, packed entries)."""

    def run(batches):
        for batch in batches:
            batch = batch.drop_duplicates("tid")
            payload: list[list[bytes]] = [[] for _ in range(buckets)]
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                flat, counts = shingle_arrays(part["text"], shingle)
                some = np.flatnonzero(counts)
                if not len(some):
                    continue
                tids, counts = part["tid"].to_numpy(np.int64)[some], counts[some]
                starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
                owner = np.repeat(np.arange(len(some)), counts)
                order = np.lexsort((flat, owner))
                f, o = flat[order], owner[order]
                fresh = np.ones(len(f), bool)
                fresh[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
                size = np.bincount(o[fresh], minlength=len(some)).astype(np.uint32)
                mins = min_hashes(flat, starts, max(bands * rows, SKETCH * 64))
                bitmap = np.concatenate([bitmaps(flat, owner, len(some)), sketches(mins)], axis=1)
                mins = mins[: bands * rows].reshape(bands, rows, len(some)).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(_MULTIPLIERS[4])
                    for r in range(rows):
                        key = (key ^ mins[:, r]) * np.uint64(_MULTIPLIERS[r % len(_MULTIPLIERS)])
                        key ^= key >> np.uint64(31)
                key32 = (key >> np.uint64(32)).astype(np.uint32).ravel()
                at = np.tile(np.arange(len(some), dtype=np.uint8), bands)
                bucket = (key.ravel() & np.uint64(0xFFFF)) % np.uint64(buckets)
                for b in range(buckets):
                    mine = np.flatnonzero(bucket == b)
                    if len(mine):
                        used = np.unique(at[mine])
                        new = np.zeros(256, np.uint8)
                        new[used] = np.arange(len(used))
                        head = np.array([len(used), len(mine)], np.uint32)
                        payload[b].append(b"".join((head.tobytes(), tids[used].tobytes(), size[used].tobytes(), bitmap[used].tobytes(), key32[mine].tobytes(), new[at[mine]].tobytes())))
            made = [(b, b"".join(x)) for b, x in enumerate(payload) if x]
            yield pd.DataFrame({"bucket": pd.Series([r[0] for r in made], dtype="int32"), "payload": pd.Series([r[1] for r in made], dtype=object)})

    return run


def _unpack(payloads):
    tids, sizes, maps, keys, owners, base = [], [], [], [], [], 0
    for raw in payloads:
        view, at = memoryview(raw), 0
        while at < len(view):
            n, m = np.frombuffer(view, np.uint32, 2, at)
            n, m = int(n), int(m)
            at += 8
            tids.append(np.frombuffer(view, np.int64, n, at))
            at += 8 * n
            sizes.append(np.frombuffer(view, np.uint32, n, at))
            at += 4 * n
            maps.append(np.frombuffer(view, np.uint64, n * WIDTH, at).reshape(n, WIDTH))
            at += 8 * WIDTH * n
            keys.append(np.frombuffer(view, np.uint32, m, at))
            at += 4 * m
            owners.append(np.frombuffer(view, np.uint8, m, at).astype(np.uint32) + np.uint32(base))
            at += m
            base += n
    return tuple(map(np.concatenate, (tids, sizes, maps, keys, owners)))


def possible(size_a, map_a, size_b, map_b, threshold: float) -> np.ndarray:
    """Whether the overlap can reach the threshold: tokens whose bit the other side lacks are certainly not shared, and the
    sketches of what is behind the bitmaps, if anything, agree in enough bits."""
    near = None
    if map_a.shape[-1] > SIGNATURE:
        near = SKETCH * 64 - np.bitwise_count(map_a[..., SIGNATURE:] ^ map_b[..., SIGNATURE:]).sum(-1, dtype=np.int64) >= agreeing(threshold)
        map_a, map_b = map_a[..., :SIGNATURE], map_b[..., :SIGNATURE]
    most = np.minimum(size_a.astype(np.int64) - np.bitwise_count(map_a & ~map_b).sum(-1, dtype=np.int64), size_b.astype(np.int64) - np.bitwise_count(map_b & ~map_a).sum(-1, dtype=np.int64))
    fits = most * (1 + threshold) >= threshold * (size_a.astype(np.int64) + size_b) - 1e-9
    return fits if near is None else fits & near


class Forest:
    """A signature tree for each group of texts, all of them built and searched at once.

    Level 0 are the texts of a group by size; each node above holds an OR-combined bitmap and the range of set sizes below
    it. ``groups`` numbers the group of each text (ascending); without it all texts are one group.
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, groups: np.ndarray | None = None):
        groups = np.zeros(len(sizes), np.int64) if groups is None else groups
        self.order = np.lexsort((maps[:, 0], sizes, groups)) if len(sizes) else np.zeros(0, np.int64)
        low = high = sizes[self.order].astype(np.int64)
        full, group = maps[self.order], groups[self.order]
        m = full[:, :SIGNATURE]
        # tokens that share a bit with another token of their text
        extra = low - np.bitwise_count(m).sum(1, dtype=np.int64)
        #: per level: sizes, bitmap, shared bits, first child of every node and of the one behind the last
        self.levels = [(low, high, full, extra, None)]
        fan = LEAF
        while len(group) and (len(self.levels) == 1 or (group[1:] == group[:-1]).any()):
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
            cut = np.flatnonzero(place % fan == 0)
            low, high, m, extra = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(m, cut, axis=0), np.maximum.reduceat(extra, cut)
            self.levels.append((low, high, m, extra, np.append(cut, len(group))))
            group, fan = group[cut], FAN
        #: pairs of nodes looked at and dropped, and pairs of texts looked at and dropped
        self.nodes = self.pruned = self.texts = self.dropped = 0

    def _fits(self, level: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        low, high, m, extra, _ = self.levels[level]
        if level == 0:
            return possible(low[a], m[a], low[b], m[b], t)
        # two texts below share at most the bits in common and what shares a bit in the one or the other
        most = np.minimum(np.bitwise_count(m[a] & m[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b]), np.minimum(high[a], high[b]))
        return (most * (1 + t) >= t * (low[a] + low[b]) - 1e-9) & (high[a] >= t * low[b] - 1e-9) & (high[b] >= t * low[a] - 1e-9)

    def pairs(self, threshold: float, block: int = 100_000):
        """Index pairs of texts of a group that may reach the threshold, by dual traversal from the roots."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > block:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            ok = self._fits(level, a, b, threshold)
            if level == 0:
                self.texts, self.dropped = self.texts + len(ok), self.dropped + int((~ok).sum())
                yield self.order[a[ok]], self.order[b[ok]]
                continue
            self.nodes, self.pruned = self.nodes + len(ok), self.pruned + int((~ok).sum())
            a, b = a[ok], b[ok]
            child = self.levels[level][4]
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            # all pairs of children, of a node with itself each once
            many = na * nb
            at = np.repeat(np.arange(len(a)), many)
            k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            x, y = child[a][at] + k // nb[at], child[b][at] + k % nb[at]
            keep = x < y if level == 1 else x <= y
            stack.append((level - 1, x[keep], y[keep]))


def _meet(threshold: float):
    """All packets of a bucket to candidate pairs (a < b) of text ids."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tids, sizes, maps, keys, owners = _unpack(part["payload"])
        tid, first, inverse = np.unique(tids, return_index=True, return_inverse=True)
        sizes, maps, who = sizes[first], maps[first], inverse.astype(np.uint32)[owners]
        del tids, first, inverse, owners
        found, seen = [], set()
        # a part of the keys at a time, to need little memory
        for part in range(KEY_PARTS):
            mine = keys % np.uint32(KEY_PARTS) == part
            found += _groups(keys[mine], who[mine], sizes, maps, threshold, seen)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
        return pd.DataFrame({"a": tid[(pairs >> np.uint64(32)).astype(np.int64)], "b": tid[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]})

    return run


#: Largest size of a filter, in bits; beyond it a filter lets more pass, but loses nothing.
FILTER_BITS = 1 << 26


def filter_of(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap of hashed ids, of bounded size: its words are combined by the aggregation, the driver gets each word once."""
    size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * ids.count()).bit_length()))

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(_place(x, size))

    at = ids.select(place(column).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(31 - (at & 31) as int))")).alias("bits")).toPandas()
    whole = np.zeros(size // 32, ">u4")
    whole[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return whole.view(np.uint8)


def _place(ids: pd.Series, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.to_numpy(np.int64).view(np.uint64) * np.uint64(_MULTIPLIERS[0])) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def in_filter(bits: np.ndarray, ids: pd.Series) -> np.ndarray:
    at = _place(ids, len(bits) * 8)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _groups(keys: np.ndarray, owners: np.ndarray, sizes: np.ndarray, maps: np.ndarray, threshold: float, seen: set, block: int = 2_000_000) -> list[np.ndarray]:
    """Coded pairs (smaller text above, larger below) of all groups of equal keys; a large group of the same texts is searched once."""
    code = np.unique((keys.astype(np.uint64) << np.uint64(32)) | owners.astype(np.uint64))
    keys, who = (code >> np.uint64(32)), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(keys)))
    wanted = length > 1
    for i in np.flatnonzero(length > LARGE):
        mark = xxhash.xxh3_128_digest(who[start[i] : start[i] + length[i]].tobytes())
        wanted[i] = mark not in seen
        seen.add(mark)
    keep = np.repeat(wanted, length)
    who, group = who[keep], np.repeat(np.arange(int(wanted.sum())), length[wanted])
    found, ends = [], np.cumsum(length[wanted])
    lo = 0
    while lo < len(who):
        # whole groups, about ``block`` texts at a time
        hi = int(ends[np.searchsorted(ends, min(lo + block, len(who)))])
        members = who[lo:hi]
        for a, b in Forest(sizes[members], maps[members], group[lo:hi]).pairs(threshold):
            a, b = members[a], members[b]
            found.append(np.unique((np.minimum(a, b).astype(np.uint64) << np.uint64(32)) | np.maximum(a, b).astype(np.uint64)))
        lo = hi
    return found


def texts_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (id, tid, text) with non-null id and text; equal texts have equal tid."""
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").select("id", F.xxhash64("text").alias("tid"), "text")


def similar_classes(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of different texts with at least the threshold, and membership (id, tid).

    a < b are text ids (hashes). Texts of fewer words than a shingle have none and are similar to nothing; null texts and
    ids are ignored; repeated rows count once; further columns are not read.
    """
    rows = texts_of(df, key, text)
    members = rows.select("id", "tid").distinct()
    count = rows.count()
    height, bands = shape(threshold)
    if buckets is None:
        buckets = max(6, -(-count * bands * 6 // 48_000_000))
    packets = rows.select("tid", "text").mapInPandas(_packets(shingle, height, bands, buckets), "bucket int, payload binary")
    meet = _meet(threshold)

    def each(batches):
        # a partition is a bucket: by number, since hashing the numbers would put several into one
        parts = [b["payload"] for b in batches if len(b)]
        if parts:
            yield meet(pd.DataFrame({"payload": pd.concat(parts)}))

    met = packets.repartitionById(buckets, F.col("bucket")).mapInPandas(each, "a long, b long").distinct()
    candidates = materialize(met)
    wanted = candidates.select(F.col("a").alias("tid")).unionByName(candidates.select(F.col("b").alias("tid")))
    bits = filter_of(wanted, "tid")

    def tokens(batches):
        for batch in batches:
            batch = batch[in_filter(bits, batch["tid"])].drop_duplicates("tid")
            yield pd.DataFrame({"tid": batch["tid"], "tokens": [x.view(np.uint8).reshape(-1, 8)[:, :TOKEN].tobytes() for x in shingle_sets(batch["text"], shingle)]})

    # no text is shuffled, only the token sets of candidates; what the filter lets pass wrongly finds no partner in the join
    sets = materialize(rows.select("tid", "text").mapInPandas(tokens, "tid long, tokens binary"))

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, f"V{TOKEN}"), np.frombuffer(q, f"V{TOKEN}")
            both = len(set(p.tolist()) & set(q.tolist()))
            out.append(both / max(1, len(p) + len(q) - both))
        return pd.Series(out)

    scored = candidates.join(sets.select(F.col("tid").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("tid").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", jaccard("x", "y").alias("similarity"))
    # equal texts in different files gave equal sets, hence repeated pairs
    return scored.where(F.col("similarity") >= threshold).distinct(), members


def similar_rows(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """All pairs (id_a, id_b, similarity), id_a < id_b, of rows whose texts reach the threshold, exact copies included."""
    pairs, members = similar_classes(df, key, text, shingle, threshold, **options)
    members = materialize(members)
    different = pairs.join(members.select(F.col("id").alias("x"), F.col("tid").alias("a")), "a").join(members.select(F.col("id").alias("y"), F.col("tid").alias("b")), "b")
    repeated = members.groupBy("tid").count().where("count > 1")
    enough = texts_of(df, key, text).join(repeated, "tid", "left_semi").where(F.col("text").rlike("[\\p{L}\\p{N}]" + "[\\p{L}\\p{N}]*+[^\\p{L}\\p{N}]++[\\p{L}\\p{N}]" * (shingle - 1))).select("id", "tid").distinct()
    copies = enough.select(F.col("id").alias("x"), "tid").join(enough.select(F.col("id").alias("y"), "tid"), "tid").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    both = different.select("x", "y", "similarity").unionByName(copies)
    return both.where("x <> y").groupBy(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).agg(F.max("similarity").alias("similarity"))


def similar_groups(df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """One row (id, group, copies, links) per row with a text: the smallest id of its connected group, how many rows have
    exactly its text, and to how many other texts it is linked. Copies are not expanded into pairs."""
    pairs, members = similar_classes(df, key, text, shingle, threshold, **options)
    pairs, members = materialize(pairs), materialize(members)
    heads = members.groupBy("tid").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    linked = pairs.select(F.col("a").alias("tid")).unionByName(pairs.select(F.col("b").alias("tid"))).groupBy("tid").agg(F.count("*").alias("links"))
    parts = components(pairs, "a", "b").select(F.col("node").alias("tid"), "component")
    classes = heads.join(linked, "tid", "left").join(parts, "tid", "left").select("tid", "head", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.coalesce("component", "tid").alias("component"))
    named = classes.groupBy("component").agg(F.min("head").alias("group"))
    return members.join(classes, "tid").join(named, "component").select("id", "group", "copies", "links")
