"""Language ID with interpolated Kneser-Ney character models.

Each language has a character model with interpolated Kneser-Ney smoothing: raw counts at the
top order, continuation counts below, one discount per order. Models are stored in groups of
``TOGETHER`` languages as sorted arrays of n-gram hashes, one per order, beside a matrix with a
column per language; a text is scored by binary search, with back-off only for n-grams that no
language of the group knows. Groups only bound the matrices, so that memory grows with the
number of languages and not with its square: a language's figures are the same in any group.
The language with the lowest cross-entropy per symbol is chosen.

Learning takes ``SAMPLE`` documents a language (expected number; chosen by a hash of the id,
whole texts) from those with crc32(id) mod 5 not 0; remainders 1 to 3 are counted, remainder 4
calibrates: the sharpness that turns cross-entropies into probabilities, and for each
language the cross-entropy above which a text is rejected as being none of the languages. All
n-grams of the sample enter the models, so ``SAMPLE`` is what bounds them. Any number of labels
is learned, at the cost of a pass over a text for each ``TOGETHER`` of them. Predictions read
nothing but the text, whole.

Defined results for odd input: a null text or one without a letter is ``und`` with score 0,
and rejected; with nothing to learn from all are. Null ids are not held out and not learned
from; null languages are not learned from, nor are languages of which no sampled text has
``ORDER`` symbols. Equal rows each get their own result; an empty table gives an empty result.
Very long texts are scored in pieces with the same result. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import bounded
from .staging import discard, stage, table

ORDER = 4
#: Documents of a language to learn from, a bounded sample of the labelled rows.
SAMPLE = 3000
#: Languages whose models stand in one matrix.
TOGETHER = 8
#: Symbols scored at a time.
PIECE = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its own value if it is a letter, else a space's."""
    if not _TABLE:
        _TABLE.append(np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32))
    return _TABLE[0]


def symbols(text: str) -> Iterator[np.ndarray]:
    """Letters in lower case, one space for all between them, a space at either end; in pieces.

    Each piece begins with the last ``ORDER - 1`` symbols of the one before.
    """
    before = np.array([32], dtype=np.uint32)
    for at in range(0, max(len(text), 1), PIECE):
        codes = letters()[np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + PIECE >= len(text):
            codes = np.append(codes, np.uint32(32))
        codes = np.concatenate((before, codes))
        keep = np.ones(len(codes), dtype=bool)
        keep[len(before) :] = (codes[len(before) :] != 32) | (codes[len(before) - 1 : -1] != 32)
        codes = codes[keep]
        yield codes
        before = codes[-(ORDER - 1) :]


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of each n-gram of so many symbols."""
    n = len(codes) - order + 1
    out = np.full(max(n, 0), order, dtype=np.uint64)
    for i in range(order if n > 0 else 0):
        out = (out ^ codes[i : i + n].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def gram_hash(grams: list[str], order: int) -> np.ndarray:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return hashes(codes, order)[::order] if len(grams) else np.empty(0, dtype=np.uint64)


@dataclass
class Level:
    """One order: hashes of n-grams with log-probabilities, of contexts with log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


class Group:
    """The character models of a few languages."""

    def __init__(self, langs: list[str], counts: dict[str, pd.Series], floor: float, order: int = ORDER):
        self.langs, self.order, self.floor = langs, order, floor
        by_order: dict[int, list[pd.Series]] = {order: [counts[x] for x in langs]}
        for k in range(order - 1, 0, -1):
            by_order[k] = [pd.Series(s.index.str[1:]).value_counts() for s in by_order[k + 1]]
        self.levels: list[Level] = []
        for k in range(1, order + 1):
            self.levels.append(self._level(k, by_order[k]))

    def _level(self, k: int, series: list[pd.Series]) -> Level:
        grams = sorted(set().union(*(s.index for s in series)))
        heads = sorted({g[:-1] for g in grams})
        lower = self.score_grams([g[1:] for g in grams], k - 1)
        backoff = np.zeros((len(heads), len(series)), dtype=np.float64)
        logp = np.empty((len(grams), len(series)), dtype=np.float64)
        head = pd.Index(heads).get_indexer([g[:-1] for g in grams])
        for j, s in enumerate(series):
            c = s.reindex(grams, fill_value=0).to_numpy(dtype=np.float64)
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
            total = np.bincount(head, weights=c, minlength=len(heads))
            kinds = np.bincount(head, weights=c > 0, minlength=len(heads))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            with np.errstate(divide="ignore"):
                backoff[:, j] = np.log(weight)
                logp[:, j] = np.log(np.maximum(c - discount, 0) / np.maximum(total, 1)[head] + weight[head] * np.exp(lower[:, j]))
        keys, contexts = gram_hash(grams, k), gram_hash(heads, k - 1) if k > 1 else np.zeros(1, dtype=np.uint64)
        a, b = np.argsort(keys), np.argsort(contexts)
        return Level(keys[a], logp[a].astype(np.float32), contexts[b], backoff[b].astype(np.float32))

    def score_grams(self, grams: list[str], k: int) -> np.ndarray:
        if k == 0:
            return np.full((len(grams), len(self.langs)), self.floor)
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(grams), k)
        return self._score([codes[:, i:] for i in range(k)], k)

    def _score(self, suffixes: list[np.ndarray], k: int) -> np.ndarray:
        """Log-probabilities of rows of symbols; suffixes[i] are the rows without the first i symbols."""
        out = np.zeros((len(suffixes[0]), len(self.langs)), dtype=np.float32)
        todo = np.arange(len(out))
        for n in range(k, 0, -1):
            level, rows = self.levels[n - 1], suffixes[k - n][todo]
            at, found = look_up(level.keys, self._hash(rows, n))
            out[todo[found]] += level.logp[at[found]]
            todo, rows = todo[~found], rows[~found]
            if not len(todo):
                return out
            if n == 1:
                out[todo] += level.backoff[0] + np.float32(self.floor)
                return out
            at, found = look_up(level.contexts, self._hash(rows[:, :-1], n - 1))
            out[todo[found]] += level.backoff[at[found]]
        return out

    @staticmethod
    def _hash(rows: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(rows), n, dtype=np.uint64)
        for i in range(n):
            out = (out ^ rows[:, i].astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(29)
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities by language, and number of symbols, for each text."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        room = max(1 << 15, PIECE * 4 // max(4, len(self.langs)))
        batch: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal batch, held
            if not batch:
                return
            codes = np.concatenate([c for _, c in batch])
            windows = np.lib.stride_tricks.sliding_window_view(codes, self.order)
            size = np.array([len(c) for _, c in batch])
            ends = np.cumsum(size)
            good = np.ones(len(windows), dtype=bool)
            for i in range(1, self.order):  # windows that reach into the next text
                good[ends[:-1] - i] = False
            top = hashes(codes, self.order)[good]
            level = self.levels[-1]
            at, found = look_up(level.keys, top)
            logp = level.logp[at]
            if not found.all():
                rows = windows[good][~found]
                logp[~found] = self._score([rows[:, i:] for i in range(self.order)], self.order)
            starts = np.cumsum(np.concatenate(([0], size[:-1] - self.order + 1)))
            part = np.add.reduceat(logp.astype(np.float64), starts, axis=0)
            for (k, c), row in zip(batch, part, strict=True):
                total[k] += row
                n[k] += len(c) - self.order + 1
            batch, held = [], 0

        for k, text in enumerate(texts):
            for codes in symbols(text):
                if len(codes) < self.order:
                    codes = np.concatenate((np.full(self.order - len(codes), 32, dtype=np.uint32), codes))
                batch.append((k, codes))
                held += len(codes)
                if held >= room:
                    flush()
        flush()
        return total, n


class Models:
    """The character models of all languages, and how to decide between them."""

    def __init__(self, langs: list[str], groups: list[Group]):
        self.langs, self.groups = langs, groups
        self.place = {x: j for j, x in enumerate(langs)}
        self.sharpness = 1.0
        self.limits = np.full(len(langs), np.inf)

    @staticmethod
    def of(counts: dict[str, pd.Series], order: int = ORDER) -> Models:
        """From counts of n-grams by language."""
        langs = sorted(counts)
        floor = floor_of({c for s in counts.values() for g in s.index for c in g})
        return Models(langs, [Group(part, counts, floor, order) for part in parts(langs)])

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities by language, and number of symbols, for each text."""
        got = [g.sums(texts) for g in self.groups]
        return np.concatenate([t for t, _ in got], axis=1), got[0][1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score, and whether it is rejected, of each text."""
        lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        some = [i for i, x in enumerate(texts) if x and _LETTER.search(x)] if self.langs else []
        if some:
            total, n = self.sums([texts[i] for i in some])
            entropy = -total / n[:, None]
            chance = self.chances(entropy, n)
            best = entropy.argmin(axis=1)
            for i, j, e, c in zip(some, best, entropy, chance, strict=True):
                lang[i], score[i], out[i] = self.langs[j], float(c[j]), bool(e[j] > self.limits[j])
        return lang, score, out

    def chances(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] * self.sharpness
        x = np.exp(x)
        return x / x.sum(axis=1, keepdims=True)

    def calibrate(self, entropy: np.ndarray, n: np.ndarray, truth: np.ndarray) -> None:
        """Sharpness by likelihood; limits by the cross-entropies that texts of a language have."""

        def loss(s: float) -> float:
            self.sharpness = s
            return -float(np.log(np.maximum(self.chances(entropy, n)[np.arange(len(n)), truth], 1e-12)).mean())

        self.sharpness = min((0.1 * 2**i for i in range(9)), key=loss)
        for j in range(len(self.langs)):
            own = entropy[truth == j, j]
            if len(own):
                # beyond nearly all texts of the language, with a margin of a nat per symbol
                self.limits[j] = float(np.quantile(own, 0.999)) + 1.0


def parts(langs: list[str]) -> list[list[str]]:
    return [langs[i : i + TOGETHER] for i in range(0, len(langs), TOGETHER)]


def floor_of(alphabet: set[str]) -> float:
    """Log-probability of a symbol under no model: all symbols of the sample, and one for others."""
    return -float(np.log(len(alphabet) + 1))


def _split(found: np.ndarray) -> list[str]:
    text = found.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + ORDER] for i in range(0, len(text), ORDER)]


def _rows(seen: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([g for _, g in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def remainder(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Models:
    """Models from a bounded sample of the labelled documents that aren't held out."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), remainder(id_col).alias("fold"), F.xxhash64(F.col(id_col)).alias("h"))
    rows = rows.where("fold <> 0 AND lang IS NOT NULL AND text IS NOT NULL")
    shares = stage(rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), sample / F.col("count")).alias("share")), "shares")
    rows = rows.join(bounded(shares, shares.count()), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("text", "lang", "fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for codes in symbols(text) if _LETTER.search(text) else ():
                    if len(codes) < ORDER:
                        continue
                    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, ORDER))
                    found, n = np.unique(windows.view(f"V{4 * ORDER}").ravel(), return_counts=True)
                    for g, k in zip(_split(found), n.tolist(), strict=True):
                        seen[lang, g] = seen.get((lang, g), 0) + k
                if len(seen) > 500_000:
                    yield _rows(seen)
                    seen.clear()
        yield _rows(seen)

    counted = stage(rows.where("fold < 4").select("text", "lang").mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = [r.lang for r in counted.select("lang").distinct().orderBy("lang").collect()]
    letters = counted.select(F.explode(F.split("gram", "")).alias("c")).distinct().collect()
    floor, groups = floor_of({r.c for r in letters if r.c}), []
    for part in parts(langs):  # one group at a time is on the driver as strings
        got = counted.where(F.col("lang").isin(part)).toPandas()
        groups.append(Group(part, {x: g.set_index("gram")["n"] for x, g in got.groupby("lang")}, floor))
    models = Models(langs, groups)
    if langs:
        calibrate(models, rows.where("fold = 4").select("text", "lang"))
    discard(counted, shares)
    return models


def calibrate(models: Models, rows: DataFrame) -> None:
    """Cross-entropies of the calibration sample, scored by the workers; figures only reach the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                pairs = [(t, x) for t, x in zip(b.slice(at, 256).column(0).to_pylist(), b.slice(at, 256).column(1).to_pylist(), strict=True) if x in shared.value.place and _LETTER.search(t)]
                if pairs:
                    total, n = shared.value.sums([t for t, _ in pairs])
                    cols = [pa.array([shared.value.place[x] for _, x in pairs], pa.int32()), pa.array(n, pa.int64()), pa.array(list(-total / n[:, None]), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["truth", "n", "entropy"])

    got = rows.mapInArrow(run, "truth int, n long, entropy array<double>").toPandas()
    if len(got):
        models.calibrate(np.array(got["entropy"].tolist()), got["n"].to_numpy(), got["truth"].to_numpy())


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, and whether the text is rejected as none of the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lang, score, out = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield part.filter(pa.array([not x for x in shared.value.predict(part.column(at).to_pylist())[2]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_kneser_ney_language": op10_kneser_ney_language}
SQL: dict[str, str] = {}
