"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text fall into quantile bins. Boosting goes round the features in turn: each step fits a
shallow tree to the gradient's histogram over one feature's bins and adds it to that feature's lookup
table. Pairs of features that explain most of what is left get two-dimensional tables in the same way.
A score is the sum of looked-up bins, for a whole batch at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastrel.llm._io import map_slices
from rastrel.llm._words import SPACE, U64, _BYTE, flat, mix, spans, word_hashes
from rastrel.llm.quality_rules import STOP_WORDS

#: Labelled rows that a model learns from at most, chosen by a hash of their ids over the whole table.
SAMPLE = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES = 32, 150, 60, 6, 0.1, 4
#: Documents with a lower score are rejected.
CUT = 0.7
FEATURES = (
    "log_words", "mean_word_bytes", "marks_per_word", "shouts_per_word", "stops_per_word", "upper_share", "stop_word_ratio",
    "distinct_ratio", "same_as_before", "top_word_share", "dup_line_ratio", "words_per_line", "digit_share", "odd_byte_share",
)


def _lut(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = 1
    return out


_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_CLASSES = {"marks": _lut("#*$%&|<>@^~_=+{}[]\\/"), "shouts": _lut("!?"), "stops": _lut(".,;:"), "upper": _lut(bytes(range(65, 91))), "letters": _LETTER.astype(np.int64), "digits": _lut("0123456789"), "odd": _lut(bytes([*range(0, 9), *range(14, 32), 127]))}


def _name(words: list[str]) -> np.ndarray:
    raw, offs = flat(pa.array(words))
    return np.sort(word_hashes(raw, offs[:-1], offs[1:]))


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for every whole text; null and empty texts have zeros."""
    raw, offs = flat(texts)
    n = len(texts)
    starts, ends, bounds = spans(raw, offs)
    words = np.diff(bounds).astype(float)
    per = lambda x: np.r_[0, np.cumsum(x)][offs[1:]] - np.r_[0, np.cumsum(x)][offs[:-1]]
    count = {k: per(v[raw]).astype(float) for k, v in _CLASSES.items()}
    some, size = np.maximum(words, 1), np.maximum(np.diff(offs), 1)
    word_bytes = per((~SPACE[raw]).astype(np.int64))

    # Runs of letters, in lower case of A-Z.
    low = _LOWER[raw]
    a, b, at = spans(low, offs, ~_LETTER)
    names = word_hashes(low, a, b)
    tokens = np.maximum(np.diff(at), 1).astype(float)
    row = np.repeat(np.arange(n), np.diff(at))
    stop = _name(STOP_WORDS)
    is_stop = stop[np.minimum(np.searchsorted(stop, names), len(stop) - 1)] == names
    same = np.r_[False, (names[1:] == names[:-1]) & (row[1:] == row[:-1])] if len(names) else np.zeros(0, bool)
    order = np.lexsort((names, row))
    sorted_names, sorted_rows = names[order], row[order]
    new = np.r_[True, (sorted_names[1:] != sorted_names[:-1]) | (sorted_rows[1:] != sorted_rows[:-1])] if len(names) else np.zeros(0, bool)
    opens = np.flatnonzero(new)
    often = np.zeros(n)
    np.maximum.at(often, sorted_rows[opens], np.diff(np.r_[opens, len(names)]))

    # Lines with a word; equal ones by a hash of their bytes.
    la, lb, line_at = spans(raw, offs, np.arange(256) == 10)
    filled = np.searchsorted(starts, lb) > np.searchsorted(starts, la)
    line_names, line_row = word_hashes(raw, la, lb)[filled], np.repeat(np.arange(n), np.diff(line_at))[filled]
    lines = np.bincount(line_row, minlength=n).astype(float)
    _, one = np.unique(mix(line_names) + line_row.astype(U64) * _BYTE[1], return_index=True)
    distinct_lines = np.bincount(line_row[one], minlength=n)
    by_row = lambda x: np.bincount(row, weights=x.astype(float), minlength=n)
    out = [
        np.log1p(words), word_bytes / some, count["marks"] / some, count["shouts"] / some, count["stops"] / some,
        count["upper"] / np.maximum(count["letters"], 1), by_row(is_stop) / tokens, np.bincount(sorted_rows[opens], minlength=n) / tokens,
        by_row(same) / tokens, often / tokens, (lines - distinct_lines) / np.maximum(lines, 1), words / np.maximum(lines, 1), count["digits"] / size, count["odd"] / size,
    ]
    return np.stack(out, axis=1)


class Model(NamedTuple):
    edges: list[np.ndarray]  # by feature, ascending: a value's bin is how many do not exceed it
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[at[:, i], at[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values by bin of a greedy tree over ordered bins."""
    cuts, cg, ch = [0, len(g)], np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    while len(cuts) <= leaves:
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            inner = np.arange(a + 1, b)
            if len(inner):
                gain = _gain(cg[inner] - cg[a], ch[inner] - ch[a]) + _gain(cg[b] - cg[inner], ch[b] - ch[inner]) - _gain(cg[b] - cg[a], ch[b] - ch[a])
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(inner[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best tree that cuts each of two axes once."""
    best, out = -1.0, np.zeros_like(g)
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    n, m = g.shape
    if n < 2 or m < 2:
        return best, out
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None]
    corner = lambda c: (c[i, j], c[i, m] - c[i, j], c[n, j] - c[i, j], c[n, m] - c[i, m] - c[n, j] + c[i, j])
    parts = list(zip(corner(cg), corner(ch), strict=True))
    gain = sum(_gain(a, b) for a, b in parts)
    p, q = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [float(a[p, q] / (b[p, q] + 1.0)) for a, b in parts]
    out[: p + 1, : q + 1], out[: p + 1, q + 1 :], out[p + 1 :, : q + 1], out[p + 1 :, q + 1 :] = values
    return float(gain[p, q]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learn from features and labels 0 or 1. Without rows, or with one label alone, all texts score that share."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(len(FEATURES))]
    # Rare values matter too: of a feature that is nearly always one value, the rest is cut by its own quantiles.
    for k in range(len(FEATURES)):
        if len(x) and len(edges[k]) < BINS // 2:
            values = np.unique(x[:, k])
            if len(values) > 1:
                middle = (values[1:] + values[:-1]) / 2
                edges[k] = np.unique(np.quantile(middle, np.linspace(0, 1, BINS)))
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not 0 < y.sum() < len(y):
        return model
    at, total = model.bins(x), np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slope()
            step = RATE * np.clip(_tree(np.bincount(at[:, k], g, len(table)), np.bincount(at[:, k], h, len(table))), -4, 4)
            table += step
            total += step[at[:, k]]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(model.tables[i]), len(model.tables[j])
        g, h = slope()
        where = at[:, i] * m + at[:, j]
        return np.bincount(where, g, n * m).reshape(n, m), np.bincount(where, h, n * m).reshape(n, m)

    ranked = sorted(((_cross(*histogram(i, j))[0], i, j) for i in range(len(FEATURES)) for j in range(i)), reverse=True)
    for _, i, j in ranked[:PAIRS]:
        model.pairs.append((i, j))
        model.pair_tables.append(np.zeros((len(model.tables[i]), len(model.tables[j]))))
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * np.clip(_cross(*histogram(i, j))[1], -4, 4)
            table += step
            total += step[at[:, i], at[:, j]]
    return model


def held_out(id_col: str) -> Column:
    """Rows that no model learns from: CRC-32 of the id as text leaves 2 modulo 4. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """A model from labelled rows that aren't held out, of `sample` ids and as many rows at most.

    Both bounds choose by a hash, of ids and of ids with texts, so that neither favours any texts. Of an id with several
    labels the mean decides, from 0.5 up for 1; null ids and labels don't count, null texts count as empty ones. Columns
    of docs other than id_col and text_col are ignored."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    # The least hashes over the whole table. Rows far beyond the bound go before the sort, so that no more
    # than about a fifth over `sample` rows come together, however many tasks there are.
    place = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    bound = int(min(1.0, (1.2 * sample + 200) / max(1, known.count())) * (1 << 40))
    chosen = known.where(place <= bound).orderBy(place, id_col).limit(sample)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)  # `sample` ids at most
    rows = rows.select("text", "y", F.xxhash64(id_col, "text").alias("place"))

    def kernel(batch: pa.RecordBatch) -> dict:
        x = features(batch.column("text"))
        return {"y": batch.column("y"), "place": batch.column("place"), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))}

    # Ids that repeat may have more rows than the sample has ids.
    got = map_slices(rows, kernel, "y double, place long, x array<double>").orderBy("place", "x").limit(sample).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy())


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT, named: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with two columns named by `named`: score double and predicted int (score >= cut).

    Every row is scored by its whole text alone, however long; a null text counts as an empty one. Ties and repeated rows
    score alike, ids don't matter, and further columns are carried along; those of docs that are named as in `named` are
    replaced. An empty table gives an empty result."""
    columns = [c for c in docs.columns if c not in named]

    def kernel(batch: pa.RecordBatch) -> dict:
        score = model.score(features(batch.column(text_col)))
        return {c: batch.column(c) for c in columns} | {named[0]: pa.array(score), named[1]: pa.array((score >= cut).astype(np.int32))}

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in columns)
    return map_slices(docs.select(columns), kernel, f"{fields}`{named[0]}` double, `{named[1]}` int", text_col)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, score, predicted) as classify(), without the text on the way back."""

    def kernel(batch: pa.RecordBatch) -> dict:
        score = model.score(features(batch.column("text")))
        return {id_col: batch.column(id_col), "score": pa.array(score), "predicted": pa.array((score >= cut).astype(np.int32))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(id_col, F.col(text_col).alias("text")), kernel, f"`{id_col}` {kind}, score double, predicted int")
