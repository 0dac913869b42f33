"""Exact pools of best documents for many queries: a task has some of the queries and reads all blocks of documents.

Where tasks have some of the documents, each gives a pool for every query, and what they give and hold grows with queries times
tasks. Here a pool is finished in one task, so nothing but answers is moved and a task holds one pool for each query of a group.
Documents lie in the order of their ids, so of equal scores the one that comes first stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from lumbre.functions import text as tx
from lumbre.operators import inverted
from lumbre.operators.retrieval import top
from lumbre.sources.store import materialize, parallelism

#: Vectors in a block, queries whose pools a task holds at once, scores it holds at once, least number of them for which a term goes into a product of matrices, terms in one, lists that are short.
ROWS, GROUP, CELLS, PRODUCT, TERMS, SHORT = 4096, 2048, 4_000_000, 25_000, 128, 256


def in_order(documents: DataFrame) -> DataFrame:
    """Distinct documents (id, text) with a text, in the order of their ids over all partitions."""
    return documents.where("text is not null").select("id", "text").repartitionByRange(parallelism(documents), "id").distinct().sortWithinPartitions("id", "text")


def vector_blocks(ordered: DataFrame) -> DataFrame:
    """Vectors (id, v) of an ordered table in blocks (ids, v), v in single precision; written as a table. Null vectors are left out."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            for lo in range(0, batch.num_rows, ROWS):
                ids, v = (batch.column(c).slice(lo, ROWS) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).tobytes()], pa.binary())], ["ids", "v"])

    return materialize(ordered.select("id", "v").mapInArrow(run, f"ids array<{dict(ordered.dtypes)['id']}>, v binary"))


def _read(files: list[str], columns: list[str]):
    """Rows of a table in the shared folder, in its order, one at a time."""
    for uri in files:
        fs, path = pa.fs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1, columns=columns):
                yield batch


class _Ids:
    """Numbers the distinct ids of blocks that come in order."""

    def __init__(self):
        self.last, self.count = None, 0

    def places(self, ids: pa.Array) -> np.ndarray:
        if not len(ids):
            return np.empty(0, np.int64)
        fresh = np.ones(len(ids), bool)
        fresh[1:] = pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        fresh[0] = self.last is None or self.last != ids[0].as_py()
        if self.last is not None and self.last > ids[0].as_py():
            raise RuntimeError("the blocks are not in the order of their ids")
        self.last = ids[-1].as_py()
        out = self.count - 1 + np.cumsum(fresh)
        self.count = int(out[-1]) + 1
        return out


def _names(files: list[str], places: np.ndarray) -> pa.Array:
    """The ids at sorted distinct places."""
    number, parts, at = _Ids(), [], 0
    for batch in _read(files, ["ids"]):
        ids = batch.column(0)[0].values
        if ids is None:
            continue
        here = number.places(ids)
        end = int(np.searchsorted(places, number.count))
        if end > at:
            parts.append(ids.take(pa.array(np.searchsorted(here, places[at:end]))))
        at = end
    return pa.concat_arrays(parts)


class _Pool:
    """The ``k`` best places of each query of a group so far, by score rounded to ``digits``, then place."""

    def __init__(self, count: int, k: int, digits: int):
        self.count, self.k, self.step = count, k, 10.0**-digits
        self.floor = np.full(count, -np.inf)
        self.which, self.place, self.score, self.rank = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.more, self.waiting = [], 0

    def add(self, lo: int, s: np.ndarray, place: np.ndarray, exact, slack: float, least: float = -np.inf) -> None:
        """Scores ``s`` of the queries from ``lo`` on for documents at ``place``, right up to ``slack``; ``exact(i, j)`` gives the rounded ones. Only scores above ``least`` count."""
        floor, n, k = self.floor[lo : lo + len(s)], s.shape[1], self.k
        # later documents have to be better than the k-th, the first ones to be among the k best of their block
        bar = floor + 0.4 * self.step - slack
        new = np.flatnonzero(np.isinf(floor))
        if len(new) and n > k:
            bar[new] = np.partition(s[new], n - k, axis=1)[:, n - k] - self.step - 2 * slack
        hit = s >= bar.astype(s.dtype)[:, None]
        if least > -np.inf:
            hit &= s > least
        i, j = np.divmod(np.flatnonzero(hit), n)
        score = exact(i, j)
        keep = score > floor[i]
        self.more.append(((i[keep] + lo).astype(np.uint16), place[j[keep]], score[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > self.count * k // 2:
            self.close()

    def close(self) -> None:
        which, place, score = (np.concatenate(x) for x in zip((self.which, self.place, self.score), *self.more))
        order = np.argsort(-score, kind="stable")
        order = order[np.argsort(which[order], kind="stable")]
        ends = np.cumsum(np.bincount(which, minlength=self.count))
        rank = np.arange(len(order)) - np.append(0, ends[:-1])[which[order]]
        order, self.rank = order[rank < self.k], rank[rank < self.k]
        self.which, self.place, self.score = which[order], place[order], score[order]
        full = self.rank == self.k - 1
        self.floor[self.which[full]] = self.score[full]
        self.more, self.waiting = [], 0


def _near(files: list[str], v: np.ndarray, k: int, digits: int) -> _Pool:
    """Pools by inner product with the vectors in blocks: single precision tells what may enter, double precision its score."""
    pool, number = _Pool(len(v), k, digits), _Ids()
    wide, reach = v.astype(np.float64), float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0.0)))
    for batch in _read(files, ["ids", "v"]):
        place = number.places(batch.column(0)[0].values)
        m = np.frombuffer(batch.column(1)[0].as_buffer(), np.float32).reshape(len(place), v.shape[1])

        def exact(i, j, m=m):
            out = np.empty(len(i))
            for lo in range(0, len(i), 16_384):
                out[lo : lo + 16_384] = np.einsum("ij,ij->i", wide[i[lo : lo + 16_384]], m[j[lo : lo + 16_384]].astype(np.float64))
            return np.round(out, digits)

        pool.add(0, v @ m.T, place, exact, v.shape[1] * 2.0**-23 * (1e-9 + reach * float(np.sqrt((m * m).sum(1).max()))))
    pool.close()
    return pool


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _tasks(asked: DataFrame) -> int:
    """Tasks for queries: all cores, more only while each has some hundreds, as every task reads all blocks."""
    return max(asked.sparkSession.sparkContext.defaultParallelism, min(parallelism(asked), -(-asked.count() // 512)))


def nearest(queries: DataFrame, blocked: DataFrame, k: int = 10, places: int = 5) -> DataFrame:
    """The ranking of :func:`retrieval.dense` for queries (query_id, v) and vectors in blocks, for many queries or a large ``k``. Vectors are taken in single precision."""
    kind_q, kind_x = dict(queries.dtypes)["query_id"], dict(blocked.dtypes)["ids"][6:-1]
    asked = materialize(queries.where("v is not null").select("query_id", "v"))
    files = sorted(blocked.inputFiles())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                pool = _near(files, _vectors(part.column(1)), k, places)
                if len(pool.place):
                    some, at = np.unique(pool.place, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pool.which)), _names(files, some).take(pa.array(at)), pa.array(pool.score)], ["query_id", "id", "score"])

    return top(asked.repartition(_tasks(asked), "query_id").mapInArrow(run, f"query_id {kind_q}, id {kind_x}, score double"), k)


def _lexical(files: list[str], terms: list[np.ndarray], k: int, digits: int, n: int, mean: float, k1: float, b: float) -> _Pool:
    """Pools by BM25 with the inverted lists in blocks; ``terms``: hashes of each query, repeats included."""
    pool, number = _Pool(len(terms), k, digits), _Ids()
    found = [np.unique(t, return_counts=True) for t in terms]
    end = np.append(0, np.cumsum([len(t) for t, _ in found]))
    h, qtf = (np.concatenate(x) for x in zip(*found))
    known, at = np.unique(h, return_inverse=True)
    df = np.zeros(len(known))
    for batch in _read(files, ["n", "terms", "counts", "heads"]):
        row = batch.to_pylist()[0]
        # the totals of a partition
        if not row["heads"] and row["terms"]:
            t, c = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["counts"], np.int64)
            to = np.minimum(np.searchsorted(known, t), max(0, len(known) - 1))
            same = known[to] == t if len(known) else np.zeros(len(t), bool)
            df[to[same]] += c[same]
    w = np.log(1 + (n - df + 0.5) / (df + 0.5))[at] * (k1 + 1) * qtf
    query = np.repeat(np.arange(len(terms)), np.diff(end))
    for batch in _read(files, ["ids", "heads", "lengths", "terms", "starts", "rows", "counts"]):
        ids = batch.column(0)[0].values
        if ids is None:
            continue
        x = inverted._Block(*(batch.column(c)[0].as_py() for c in range(1, 7)), lambda tf, length: tf / (tf + k1 * (1 - b + b * length / mean)))
        place, sub = number.places(ids), max(1, CELLS // max(1, x.n))
        for lo in range(0, len(terms), sub):
            some = slice(end[lo], end[min(lo + sub, len(terms))])
            s = _scores(x, h[some], query[some] - lo, w[some], min(sub, len(terms) - lo))
            pool.add(lo, s, place, lambda i, j, s=s: np.round(s[i, j], digits), 1e-9, 0.0)
    pool.close()
    return pool


def _scores(x, h: np.ndarray, query: np.ndarray, w: np.ndarray, count: int) -> np.ndarray:
    """Scores (queries x documents) of a block: terms of many queries and documents by products of matrices, the others by their lists."""
    t = np.searchsorted(x.terms, h)
    hit = np.flatnonzero(x.terms[np.minimum(t, len(x.terms) - 1)] == h) if len(x.terms) else np.empty(0, np.int64)
    hit = hit[np.argsort(t[hit], kind="stable")]
    t, query, w = t[hit], query[hit], w[hit]
    own, first = np.unique(t, return_index=True)
    last, size = np.append(first[1:], len(t)), x.starts[own + 1] - x.starts[own]
    large = np.flatnonzero((last - first) * size > PRODUCT)
    s = np.zeros((count, x.n))
    for lo in range(0, len(large), TERMS):
        part = large[lo : lo + TERMS]
        left, right = np.zeros((count, len(part))), np.zeros((len(part), x.n))
        for i, g in enumerate(part):
            left[query[first[g] : last[g]], i] = w[first[g] : last[g]]
            a, z = x.starts[own[g]], x.starts[own[g] + 1]
            right[i, x.rows[a:z]] = x.w[a:z]
        s = left @ right if lo == 0 else s + left @ right
    rest = np.ones(len(own), bool)
    rest[large] = False
    for g in np.flatnonzero(rest & (size > SHORT)):
        a, z = x.starts[own[g]], x.starts[own[g] + 1]
        for i in range(first[g], last[g]):
            s[query[i]][x.rows[a:z]] += w[i] * x.w[a:z]
    # short lists all at once, query by query
    short = np.flatnonzero(np.repeat(rest & (size <= SHORT), last - first))
    short = short[np.argsort(query[short], kind="stable")]
    t, query, w = t[short], query[short], w[short]
    start, length = x.starts[t], x.starts[t + 1] - x.starts[t]
    total, lo = np.append(0, np.cumsum(length)), 0
    while lo < len(t):
        # whole queries, about a million entries
        hi = int(np.searchsorted(query, query[max(lo, min(len(t) - 1, int(np.searchsorted(total, total[lo] + 1_000_000)) - 1))], side="right"))
        part, low = slice(lo, hi), query[lo]
        at = np.arange(total[lo], total[hi]) - np.repeat(total[part] - start[part], length[part])
        rows = query[hi - 1] - low + 1
        s[low : low + rows] += np.bincount(np.repeat((query[part] - low) * x.n, length[part]) + x.rows[at], np.repeat(w[part], length[part]) * x.w[at], rows * x.n).reshape(rows, x.n)
        lo = hi
    return s if len(x.heads) == x.n else np.add.reduceat(s, x.heads, axis=1)


def hybrid(queries: DataFrame, documents: DataFrame, embed, k: int = 10, pool: int = 50, lexical: float = 1.0, dense: float = 1.0, c: int = 60, places: int = 5, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ranking of :func:`retrieval.fuse` over pools of :func:`retrieval.bm25` and :func:`retrieval.dense`, for queries and documents (id, text) that ``embed`` gives vectors.

    Queries of one text are ranked once. Repeated documents count once.
    """
    kind_q, kind_x = dict(queries.dtypes)["query_id"], dict(documents.dtypes)["id"]
    hashes = inverted.hashed(tx.analyze(F.col("text")))
    texts = queries.where("text is not null").groupBy("text").agg(F.collect_set("query_id").alias("q"))
    asked = materialize(texts.select("q", embed(F.col("text")).alias("v"), hashes.alias("h")))
    wanted = asked.select(F.explode("h").alias("h")).distinct().limit(inverted.WANTED + 1).toArrow()["h"].to_numpy()
    ordered = in_order(documents)
    lists = inverted.blocks(ordered.select("id", hashes.alias("t")), np.sort(wanted) if len(wanted) <= inverted.WANTED else None)
    vectors = vector_blocks(ordered.select("id", embed(F.col("text")).alias("v")))
    n, tokens = inverted.totals(lists)
    mean = tokens / n if tokens else 1.0
    list_files, vector_files = sorted(lists.inputFiles()), sorted(vectors.inputFiles())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                ends, flat = np.append(0, np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False))), part.column(2).flatten().to_numpy(zero_copy_only=False)
                pools = [(_lexical(list_files, [flat[i:j] for i, j in zip(ends[:-1], ends[1:])], pool, 4, n, mean, k1, b), lexical), (_near(vector_files, _vectors(part.column(1)), pool, 5), dense)]
                which, place, share = (np.concatenate(p) for p in zip(*((p.which.astype(np.int64), p.place, weight / (c + p.rank)) for p, weight in pools)))
                if not len(which):
                    continue
                pairs, at = np.unique(which << 40 | place, return_inverse=True)
                score, which, place = np.bincount(at, share), pairs >> 40, pairs & (1 << 40) - 1
                # all that can be among the k best by rounded score
                order = np.lexsort((-score, which))
                begin = np.searchsorted(which, np.arange(len(part)))
                last = np.minimum(begin + k, np.append(begin[1:], len(which))) - 1
                keep = score >= (score[order][np.maximum(last, 0)] - 1.01 * 10.0**-places)[which]
                which, place, score = which[keep], place[keep], score[keep]
                some, at = np.unique(place, return_inverse=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), _names(vector_files, some).take(pa.array(at)), pa.array(score)], ["q", "id", "score"])

    scored = asked.repartition(_tasks(asked), F.hash("h", "v")).mapInArrow(run, f"q array<{kind_q}>, id {kind_x}, score double")
    # a query of several texts: what its texts give is added
    return top(scored.select(F.explode("q").alias("query_id"), "id", "score"), k, places)
