"""Language identification by interpolated Kneser-Ney character models, one for each language, in sorted hash arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.functions import arrow_udf

from memspark.llm import vocab
from memspark.llm.rows import light, tidy, whole

#: Bounds of what a model is fitted on: rows of each language (chosen by a hash, so in expectation), and different words
#: over all languages. Neither grows with the corpus; every text is scored whole.
SAMPLE_ROWS = 600
SAMPLE_WORDS = 240_000
#: Characters of context and the predicted one.
ORDER = 5
#: Least bound, in standard deviations, beyond which a text is too unlike its language; see ``calibrate``.
LEAST_BOUND = 5.0
#: Least spread of a language's long texts, in bits a character: texts of mixed quality are still texts of the language.
LEAST_SPREAD = 0.25
#: Texts of less than so many characters teach nothing about a language's spread.
SHORT = 200

#: Words and units whose costs a task remembers.
CACHE_WORDS = 250_000
CACHE_UNITS = 250_000

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
START, END = 1, 2


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased; runs without a letter (such as superscript digits) are none."""
    return [w for w in LETTERS.findall(text.lower()) if w.isascii() or any(map(str.isalpha, w))]


def _codes(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(Characters of all words, each between ORDER-1 starts and an end; position after each word's end)."""
    pad = "\x01" * (ORDER - 1)
    joined = "".join([f"{pad}{w}\x02" for w in items])
    ends = np.cumsum([len(w) + ORDER for w in items])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), ends


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1- to ORDER-grams that end at each position; reaching over a word's start is harmless, as starts do not count."""
    with np.errstate(over="ignore"):
        out, power, total = [], np.uint64(1), np.zeros(len(codes), np.uint64)
        for n in range(ORDER):
            total = total.copy()
            total[n:] += codes[: len(codes) - n] * power if n else codes
            power *= np.uint64(0x9E3779B97F4A7C15)
            out.append(_mixed(total + np.uint64(n + 1) * np.uint64(0xD1B54A32D192ED03)))
    return out


@dataclass
class Model:
    """For each order, sorted hashes of the n-grams with their probability (0 where one is only a context) and their weight as a context."""

    keys: list[np.ndarray]
    prob: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    rest: float

    def costs(self, items: list[str]) -> np.ndarray:
        """The negative log2 probability of each word, its end included."""
        codes, ends = _codes(items)
        p = np.full(len(codes), self.floor)
        weight = np.full(len(codes), self.rest)
        for n, gram in enumerate(_grams(codes)):
            keys = self.keys[n]
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            found = keys[at] == gram
            own = np.where(found, self.prob[n][at], 0.0)
            p = np.where(own > 0, own, weight * p)
            # As a context, this n-gram weighs the next order one position on; unseen contexts leave all to the lower order.
            weight = np.concatenate([[1.0], np.where(found, self.back[n][at], 1.0)[:-1]])
        bits = np.where(codes == START, 0.0, -np.log2(p))
        total = np.concatenate([[0.0], np.cumsum(bits)])
        return np.diff(total[ends], prepend=0.0)


def fit(counts: dict[str, int], alphabet: int) -> Model:
    """Interpolated Kneser-Ney with one discount for each order, from words and how often they occur.

    The highest order uses occurrences, the lower ones the number of different characters that an n-gram follows.
    """
    items = list(counts)
    codes, ends = _codes(items)
    times = np.repeat(np.array([counts[w] for w in items], dtype=np.float64), np.diff(ends, prepend=0))
    grams = _grams(codes)
    real = codes != START
    zero = np.zeros(len(codes), np.uint64)
    tables = []
    for n in range(ORDER):
        g = grams[n][real]
        context = (np.concatenate([zero[:1], grams[n - 1][:-1]]) if n else zero)[real]
        suffix = (grams[n - 1] if n else zero)[real]
        if n == ORDER - 1:
            key, first, inverse = np.unique(g, return_index=True, return_inverse=True)
            number = np.bincount(inverse, weights=times[real])
        else:
            longer, once = np.unique(grams[n + 1][real], return_index=True)
            key, first, inverse = np.unique(g[once], return_index=True, return_inverse=True)
            first = once[first]
            number = np.bincount(inverse).astype(np.float64)
        tables.append((key, number, context[first], suffix[first]))
    keys, prob, back, lower, rest = [], [], [], None, 1.0
    floor = 1.0 / alphabet
    for n, (key, number, context, suffix) in enumerate(tables):
        ones, twos = (number == 1).sum(), (number == 2).sum()
        discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        owner, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, weights=number)
        weight = discount * np.bincount(inverse) / total
        below = np.full(len(key), floor) if n == 0 else lower[1][np.searchsorted(lower[0], suffix)]
        p = (number - discount) / total[inverse] + weight[inverse] * below
        lower = (key, p)
        keys.append(key)
        prob.append(p)
        if n == 0:
            rest = float(weight[0])
        else:
            back.append((owner, weight))
    back.append((np.zeros(0, np.uint64), np.zeros(0)))
    out_keys, out_prob, out_back = [], [], []
    for n in range(ORDER):
        every = np.union1d(keys[n], back[n][0])
        q, w = np.zeros(len(every)), np.ones(len(every))
        q[np.searchsorted(every, keys[n])] = prob[n]
        w[np.searchsorted(every, back[n][0])] = back[n][1]
        out_keys.append(every)
        out_prob.append(q)
        out_back.append(w)
    return Model(out_keys, out_prob, out_back, floor, rest)


class Joint:
    """The tables of several models in one: for each order the sorted hashes of all, and for each its probability and weight under every model.

    So a character's n-grams are hashed and searched once for all languages. Numbers are kept in 32 bits.
    """

    def __init__(self, models: list[Model]):
        self.floor = np.array([m.floor for m in models])
        self.rest = np.array([m.rest for m in models])
        self.keys, self.prob, self.back = [], [], []
        for n in range(ORDER if models else 0):
            every = np.unique(np.concatenate([m.keys[n] for m in models]))
            prob, back = np.zeros((len(every), len(models)), np.float32), np.ones((len(every), len(models)), np.float32)
            for j, m in enumerate(models):
                at = np.searchsorted(every, m.keys[n])
                prob[at, j], back[at, j] = m.prob[n], m.back[n]
            self.keys.append(every)
            self.prob.append(prob)
            self.back.append(back)

    def costs(self, items: list[str]) -> np.ndarray:
        """The negative log2 probability of each word under each model; see ``Model.costs``."""
        codes, ends = _codes(items)
        p = np.repeat(self.floor[None, :], len(codes), axis=0)
        weight = np.repeat(self.rest[None, :], len(codes), axis=0)
        for n, gram in enumerate(_grams(codes)):
            at = np.minimum(np.searchsorted(self.keys[n], gram), len(self.keys[n]) - 1)
            found = (self.keys[n][at] == gram)[:, None]
            own = np.where(found, self.prob[n][at], 0.0)
            p = np.where(own > 0, own, weight * p)
            weight[0] = 1.0
            weight[1:] = np.where(found, self.back[n][at], 1.0)[:-1]
        bits = np.where((codes == START)[:, None], 0.0, -np.log2(p))
        total = np.concatenate([np.zeros((1, len(self.floor))), np.cumsum(bits, axis=0)])
        return np.diff(total[ends], axis=0, prepend=0.0)


@dataclass
class Identifier:
    """The models in one table with what calibration found: a sharpness for scores, and for each language (mean, spread, spread of a character, bound)."""

    languages: list[str]
    sharpness: float
    limits: np.ndarray
    joint: Joint | None = None

    def bounds(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The highest cross-entropy that is still taken for a language; higher for shorter texts."""
        mean, spread, single, bound = self.limits[best].T
        return mean + bound * np.sqrt(spread**2 + single**2 / np.maximum(n, 1))


def _scores(x: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (x - x.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def calibrate(identifier: Identifier, entropies: np.ndarray, n: np.ndarray, true: np.ndarray) -> None:
    """Set scores and rejection from labelled texts that the models were not fitted on.

    The sharpness is the one of a grid that makes the true languages likeliest. A language's cross-entropies have a mean,
    a spread between long texts and one for each character of short texts; the bound is what 99.9 % of its texts stay
    under in standard deviations, with a quarter to spare, and ``LEAST_BOUND`` at least.
    """
    if not len(true):
        return
    grid = [2.0**k for k in range(0, 9)]
    rows = np.arange(len(true))
    identifier.sharpness = max(grid, key=lambda s: np.log(np.maximum(_scores(entropies, s)[rows, true], 1e-9)).mean())
    for k in range(len(identifier.languages)):
        x, size = entropies[true == k, k], n[true == k]
        if len(x) < 5:
            continue
        long = size >= SHORT
        mean = np.median(x)
        spread = max(LEAST_SPREAD, x[long].std() if long.sum() > 4 else x.std())
        single = max(1.0, np.sqrt(np.mean(size[~long] * (x[~long] - mean) ** 2)) if (~long).sum() > 4 else 2.0)
        z = (x - mean) / np.sqrt(spread**2 + single**2 / np.maximum(size, 1))
        identifier.limits[k] = mean, spread, single, max(LEAST_BOUND, 1.25 * float(np.quantile(z, 0.999)))


class Scorer:
    """Cross-entropies of texts under every model. Each different unit and word is looked up once while it is remembered."""

    def __init__(self, joint: Joint):
        self.joint, self.width = joint, len(joint.floor) + 1
        self.row: dict[str, int] = {}
        self.known = np.zeros((1, self.width), dtype=np.float32)  # row 0: no word
        self.unit: dict[str, int] = {}
        self.sums = np.zeros((0, self.width))

    def _learn(self, new: list[str]) -> None:
        if len(self.row) > CACHE_WORDS:
            self.row.clear()
            self.known = self.known[:1]
        start = len(self.known)
        made = [self.known]
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            made.append(np.column_stack([self.joint.costs(some), [len(w) + 1 for w in some]]).astype(np.float32))
        self.known = np.concatenate(made)
        self.row |= zip(new, range(start, len(self.known)), strict=True)

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits a character under each model, characters) of each text; 0 characters where there is no letter."""
        distinct, index, first = vocab.units(texts)
        if len(self.unit) > CACHE_UNITS:
            self.unit.clear()
            self.sums = self.sums[:0]
        if new := [u for u in distinct if u not in self.unit]:
            self.unit |= zip(new, range(len(self.sums), len(self.sums) + len(new)), strict=True)
            self.sums = np.concatenate([self.sums, self._units(new)])
        each = self.sums[np.fromiter(map(self.unit.__getitem__, distinct), np.int64, len(distinct))]
        total = vocab.sums(each, index, first)
        n = np.rint(total[:, -1])
        return total[:, :-1] / np.maximum(n, 1)[:, None], n

    def _units(self, units: list[str]) -> np.ndarray:
        """(bits under each model, characters) of each unit, a stretch of text without white space."""
        found = [words(u) for u in units]
        wanted = {w for ws in found for w in ws}
        if len(self.row) + len(wanted) > CACHE_WORDS:
            self.row.clear()
            self.known = self.known[:1]
        if new := [w for w in wanted if w not in self.row]:
            self._learn(new)
        each = np.zeros((len(units), self.width))
        flat = np.fromiter((self.row[w] for ws in found for w in ws), dtype=np.int64)
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, found), np.int64, len(found)))
        np.add.at(each, owner, self.known[flat]) if len(flat) < 64 else _add(each, owner, self.known[flat])
        return each


def _add(out: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to its owner's; owners are in order."""
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    out[owner[begin]] = np.add.reduceat(rows.astype(np.float64), begin, axis=0)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 4; null for a null key."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 4).cast("int")


def train(labelled: DataFrame, text: str, lang: str, check: Column) -> Identifier:
    """Models and calibration from rows with a text and a language; rows where ``check`` holds calibrate, the others are learned from.

    Works on a bounded sample: in expectation ``SAMPLE_ROWS`` rows of each language, chosen by a hash, and of their
    words the most frequent, ``SAMPLE_WORDS`` in all. Words are counted where the rows are; the driver gets the counts.
    """
    share = labelled.filter(F.col(lang).isNotNull()).groupBy(lang).count().collect()
    if not share:
        return Identifier([], 1.0, np.zeros((0, 4)))
    # A hash of the row's text, so that neither partitions nor ids decide; copies of a text are chosen together.
    chance = F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(1_000_000_007)) / F.lit(1_000_000_007)
    part = F.lit(0.0)
    for r in share:
        part = F.when(F.col(lang) == r[lang], F.lit(min(1.0, SAMPLE_ROWS / r["count"]))).otherwise(part)
    some = labelled.withColumn("__check", check).withColumn("__chance", chance).filter(F.col("__chance") < part)
    some = some.filter(F.col(text).isNotNull() & F.col("__check").isNotNull()).select(F.col(lang).alias("lang"), F.col("__check").alias("check"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for language, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(language, Counter()).update(words(t))
            rows = [(k, w, c) for k, ws in seen.items() for w, c in ws.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    counted = some.filter(~F.col("check")).select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = max(1000, SAMPLE_WORDS // len(share))
    best = counted.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("nth") <= most)
    table: dict[str, dict[str, int]] = {}
    for r in best.select("lang", "word", "n").toArrow().to_pylist():
        table.setdefault(r["lang"], {})[r["word"]] = r["n"]
    languages = sorted(table)
    if not languages:
        return Identifier([], 1.0, np.zeros((0, 4)))
    alphabet = len({c for ws in table.values() for w in ws for c in w}) + 2
    models = [fit(dict(sorted(table[k].items())), alphabet) for k in languages]
    out = Identifier(languages, 8.0, np.tile([0.0, 1.0, 4.0, 1e6], (len(languages), 1)))
    out.joint = Joint(models)
    shared = labelled.sparkSession.sparkContext.broadcast(out.joint)
    entropy = T.StructType.fromDDL("lang string, bits array<double>, n double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            done = 0
            for texts in vocab.slices(batch.column(1)):
                bits, n = scorer.entropies(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(list(bits), pa.list_(pa.float64())), pa.array(n)], names=entropy.names)
                done += len(texts)

    held = [r for r in some.filter("check").select("lang", "text").mapInArrow(score, entropy).toArrow().to_pylist() if r["n"] > 0 and r["lang"] in table]
    calibrate(out, np.array([r["bits"] for r in held]).reshape(-1, len(languages)), np.array([r["n"] for r in held]), np.array([languages.index(r["lang"]) for r in held], dtype=int))
    return out


def _verdicts(one: Identifier, scorer: Scorer | None, texts: pa.Array) -> list[pa.Array]:
    """lang_pred, score, cross_entropy and accepted of each text."""
    if not one.languages:
        none = np.zeros(len(texts))
        return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(none), pa.array(none, mask=none == 0), pa.array(none > 0)]
    bits, n = scorer.entropies(texts)
    best = bits.argmin(axis=1)
    low = bits[np.arange(len(best)), best]
    score = np.where(n > 0, _scores(bits, one.sharpness)[np.arange(len(best)), best], 0.0)
    pred = [one.languages[k] if m else UNKNOWN for k, m in zip(best, n, strict=True)]
    return [pa.array(pred, pa.string()), pa.array(score), pa.array(low, mask=n == 0), pa.array((n > 0) & (low <= one.bounds(best, n)))]


def acceptance(identifier: Identifier, text: Column, spark) -> Column:
    """A column: whether the text is accepted as one of the languages. Only texts go to Python, and only verdicts return."""
    shared = spark.sparkContext.broadcast(identifier)

    @arrow_udf(T.BooleanType())
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = shared.value
        scorer = Scorer(one.joint) if one.languages else None
        for batch in batches:
            made = [_verdicts(one, scorer, texts)[3] for texts in vocab.slices(pc.fill_null(batch, ""))]
            yield pa.concat_arrays(made) if made else pa.array([], pa.bool_())
        scorer = batch = made = None  # noqa: F841
        tidy()

    return judge(text.cast("string"))


def predict(docs: DataFrame, identifier: Identifier, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, the ``keep`` columns, lang_pred, score, cross_entropy (bits a character) and accepted.

    The prediction is the language of the lowest cross-entropy by character over the whole text, ties to the first in
    order; score is its share among the languages; accepted is whether the cross-entropy is within what calibration
    found for the language. ``und``, score 0, not accepted: a text that is null or has no letter, and every text if no
    language was learned. One pass, no shuffle; the models' size is bounded by the sample, so they are broadcast.
    """
    names = [key, *keep]
    made = T._parse_datatype_string("lang_pred string, score double, cross_entropy double, accepted boolean").fields
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in names), *made])
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    passes = text in names and docs.schema[text].dataType == T.StringType()
    at = names.index(text) if passes else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        scorer = Scorer(one.joint) if one.languages else None
        for batch in batches:
            done = 0
            # The text may be among the columns that pass; it is sent once then.
            for texts in vocab.slices(pc.fill_null(batch.column(at), "")):
                own = [c.slice(done, len(texts)) for c in batch.columns[: len(names)]]
                done += len(texts)
                yield pa.RecordBatch.from_arrays([*own, *_verdicts(one, scorer, texts)], names=schema.names)

    return light(docs.select(*names, *([] if passes else [whole(text).alias("__text")]))).mapInArrow(run, schema)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on part of a partly labelled table and predict all of it: ``key``, held_out, lang_pred, score, cross_entropy, accepted.

    Rows whose ``fold`` is 2 are held out; of the others with text and language, fold 3 calibrates and folds 0 and 1 are
    learned from. Null keys belong to no fold: they are predicted, not learned from and not held out. An empty table
    gives an empty one. Repeated rows give a row each; extra columns are not looked at.
    """
    f = fold(key)
    labelled = docs.filter(F.col(lang).isNotNull() & (f != 2))
    identifier = train(labelled, text, lang, f == 3)
    out = predict(docs, identifier, key, text)
    return out.select(key, F.coalesce(fold(key) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
