"""Cutting long texts at natural boundaries where the topic changes.

Natural boundaries are paragraph breaks, line breaks (list items, table rows) and sentence ends. At each of them the words
of the block before are compared with those of the block after; valleys of that similarity mark a change of topic.
Every piece ends at the boundary of the deepest valley in its size window, and the next piece begins with an overlap.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_BOUNDARY = re.compile(r"(?P<par>\n[ \t]*\n\s*)|(?P<line>\n\s*)|(?P<sent>(?:[.!?…]+[\"'»”)\]]*|[;:](?=\s+(?:[-•*]|\d+[.)])))\s+(?=[\"'«“(\[¿¡]*[A-ZÁÉÍÓÚÜÑÇ0-9\-•*|]))|(?P<clause>;\s+)")
#: What a kind of boundary adds to the depth of its valley.
_STRENGTH = {"par": 0.5, "line": 0.3, "sent": 0.15, "clause": -0.4}
_WORD = re.compile(r"[^\W\d_]{4,}")
#: Characters of a block whose words are compared.
BLOCK = 400


def boundaries(text: str) -> list[tuple[int, float]]:
    """Positions right after a natural boundary, with the strength of its kind."""
    return [(m.end(), _STRENGTH[m.lastgroup]) for m in _BOUNDARY.finditer(text) if 0 < m.end() < len(text)]


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    return sum(n * b[w] for w, n in a.items() if w in b) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def depths(text: str, cuts: list[tuple[int, float]]) -> list[float]:
    """Depth of the similarity valley at every boundary: how far similarity rises to the nearest peaks on either side."""
    words = [(m.start(), m.group().lower()[:6]) for m in _WORD.finditer(text)]
    left, right, scores = Counter(), Counter(), []
    a = b = c = 0  # left block is words[a:b], right block words[b:c]
    for at, _ in cuts:
        while c < len(words) and words[c][0] < at + BLOCK:
            right[words[c][1]] += 1
            c += 1
        while b < c and words[b][0] < at:
            w = words[b][1]
            right[w] -= 1
            if not right[w]:
                del right[w]
            left[w] += 1
            b += 1
        while a < b and words[a][0] < at - BLOCK:
            w = words[a][1]
            left[w] -= 1
            if not left[w]:
                del left[w]
            a += 1
        scores.append(_cosine(left, right))
    n = len(scores)
    up = list(scores)  # the peak reached by climbing to the left, then to the right
    for i in range(1, n):
        if scores[i - 1] >= scores[i]:
            up[i] = up[i - 1]
    down = list(scores)
    for i in range(n - 2, -1, -1):
        if scores[i + 1] >= scores[i]:
            down[i] = down[i + 1]
    return [up[i] + down[i] - 2 * scores[i] for i in range(n)]


def _forced(text: str, low: int, high: int) -> int:
    """A cut where no natural boundary is: after the last blank, else before the last character that no mark combines with."""
    for i in range(high, low, -1):
        if text[i - 1].isspace():
            return i
    import unicodedata

    i = high
    while i > low + 1 and i < len(text) and unicodedata.combining(text[i]):
        i -= 1
    return i


def pieces(text: str, limit: int = 1500, overlap: int = 150) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of the pieces: text[start:end] has at most ``limit`` code points, text[fresh:end] is new."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    cuts = boundaries(text)
    depth = depths(text, cuts)
    out, start, fresh, k, bottom = [], 0, 0, 0, 0
    while True:
        if len(text) - start <= limit:
            out.append((start, fresh, len(text)))
            return out
        high, low = start + limit, max(fresh + 1, start + limit // 2)
        while k < len(cuts) and cuts[k][0] <= fresh:
            k += 1
        best, at, j, last = None, None, k, None
        while j < len(cuts) and cuts[j][0] <= high:
            last = cuts[j][0]
            if last >= low:
                value = depth[j] + cuts[j][1] + 0.25 * (last - start) / limit
                if best is None or value > best:
                    best, at = value, last
            j += 1
        end = at or (last if last and last > fresh + overlap else None) or _forced(text, fresh, high)
        out.append((start, fresh, end))
        begin = max(end - overlap, fresh)
        while bottom < len(cuts) and cuts[bottom][0] < begin:
            bottom += 1
        nearest = next((cuts[i][0] for i in range(bottom, len(cuts)) if cuts[i][0] >= begin), end)
        start, fresh = (nearest if nearest < end else begin), end


def split_long(df: DataFrame, key: str, text: str, carry: list[str], limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Rows (key, piece, start, fresh, end, text, carried columns) of every text longer than ``limit`` code points.

    Pieces are numbered from 1; ``text[fresh:end]`` of all pieces joined is the whole text; a piece repeats up to
    ``overlap`` characters of the one before. Null keys and texts and texts within the limit give no rows; a repeated key
    counts once, of different rows of a key the smallest; other columns are dropped.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]).where((F.length("text") > limit) & F.col("key").isNotNull())
    rows = rows.groupBy("key").agg(F.min(F.struct(*rows.columns[1:])).alias("row")).select("key", "row.*")
    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, piece int, start int, fresh int, end int, text string" + "".join(f", carry_{i} {kinds[f'carry_{i}']}" for i in range(len(carry)))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                for n, (start, fresh, end) in enumerate(pieces(row.text, limit, overlap), 1):
                    out.append((row.key, n, start, fresh, end, row.text[start:end], *row[2:]))
            made = pd.DataFrame(out, columns=["key", "piece", "start", "fresh", "end", "text", *[f"carry_{i}" for i in range(len(carry))]])
            yield made

    cut = rows.mapInPandas(run, schema)
    return cut.select(F.col("key").alias(key), "piece", "start", "fresh", "end", F.col("text").alias("piece_text"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
