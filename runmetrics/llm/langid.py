"""Language identification with spans, for texts that mix languages.

A word's score for a language is the log probability of its letter sequences, learned from labelled documents. The
script of a word narrows the candidates to the languages that use it. Viterbi with a penalty for each switch then gives
every word its language, and runs of words of one language are spans.

The model is fitted on at most about ``SAMPLE`` labelled documents of each language, chosen by a hash of id and text; it
has ``BUCKETS`` numbers a language, so its size is bounded. Languages are the values of ``lang``; these are few.

A text that is null, empty or without letters gets ``und`` and score 0, as does every text when nothing was learned.
Otherwise the language with most letters in its spans wins, of equal ones the first by name; the score is its share of
the letters, without those in scripts that it doesn't use. Texts are read whole. Repeated rows give repeated results, an empty table none; other columns take no
part, and ``lang`` only in learning.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import runs

SAMPLE = 10_000
BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SIZES = (1, 2, 3, 4)
SMOOTHING = 0.1
PENALTY = 6.0
SCRIPT_SHARE = 0.01
LEAST_SCORE = 0.3
UNDECIDED = "und"
REMEMBERED = 250_000
RUN = 4_000_000
_STEPS = 1 << 62

# First characters of the Unicode ranges of scripts.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_STARTS = np.array([start for start, _ in SCRIPTS], np.uint64)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
_OTHERS = regex.compile(r"[^\p{L}\n]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is divisible by 5 (a null id counts as no text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0


def letters(words: list[str]) -> list[str]:
    """The letters of each word (which holds no line break) in lower case."""
    return _OTHERS.sub("", "\n".join(words).lower()).split("\n")


class Features:
    """Scripts and gram buckets of words of letters, as ragged arrays over their characters with a mark at both ends."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.begins = np.cumsum(self.sizes) - self.sizes
        characters = np.frombuffer("".join(f"^{word}$" for word in words).encode("utf-32-le"), "<u4").astype(np.uint64)
        left = np.repeat(self.begins + self.sizes, self.sizes) - np.arange(len(characters))  # characters up to the word's end
        self.grams = []  # (bucket of the gram that starts at each character, whether it ends within the word)
        mixed = np.zeros(len(characters), np.uint64)
        for size in SIZES:
            shifted = np.zeros(len(characters), np.uint64)
            shifted[:max(0, len(characters) - size + 1)] = characters[size - 1:]
            mixed = mixed * _MULTIPLIER + shifted + np.uint64(size)
            self.grams.append((((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), left >= size))
        self.scripts = _SCRIPT_OF[np.searchsorted(_STARTS, characters[self.begins + 1], side="right") - 1]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): how often each gram bucket and each script occurs in the words of a language."""
    words: dict[str, Counter] = defaultdict(Counter)
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add():
        for lang, counter in words.items():
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS), np.zeros(len(SCRIPT_NAMES))
            found = [(word, n) for word, n in zip(letters(list(counter)), counter.values()) if word]
            counter.clear()
            if found:
                features, times = Features([word for word, _ in found]), np.array([n for _, n in found], float)
                each = np.repeat(times, features.sizes)
                for bucket, inside in features.grams:
                    sums[lang][0][:] += np.bincount(bucket[inside], each[inside], BUCKETS)
                sums[lang][1][:] += np.bincount(features.scripts, times, len(SCRIPT_NAMES))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            words[lang].update((text.as_py() or "").split())
            if len(words[lang]) > REMEMBERED:
                add()
    add()
    for lang, both in sums.items():
        for kind, values in enumerate(both):
            keys = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.int32()), pa.array(keys, pa.int32()), pa.array(values[keys])],
                ["lang", "kind", "key", "n"])


class Model:
    def __init__(self, langs: list[str], grams_of: np.ndarray, scripts_of: np.ndarray):
        """Counts of gram buckets and scripts, a row each language."""
        self.langs = langs
        total = grams_of.sum(axis=1, keepdims=True)
        self.logs = np.log((grams_of + SMOOTHING) / (total + SMOOTHING * BUCKETS)).T.astype(np.float32)
        self.uses = (scripts_of >= SCRIPT_SHARE * np.maximum(scripts_of.sum(axis=1, keepdims=True), 1)).T

    def score(self, words: list[str]) -> np.ndarray:
        """The score of each non-empty word of letters for each language."""
        features = Features(words)
        sums = np.zeros((int(features.sizes.sum()), len(self.langs)), np.float32)
        for bucket, inside in features.grams:
            sums[inside] += self.logs[bucket[inside]]
        scores = np.add.reduceat(sums, features.begins, axis=0) / np.float32(len(SIZES))
        allowed = self.uses[features.scripts]
        allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
        return np.where(allowed, scores, scores.min(axis=1, keepdims=True) - np.float32(2 * PENALTY))


def share(sample: int, size: int) -> int:
    """How many of ``_STEPS`` hash values choose about ``sample`` of ``size`` rows: one at least."""
    return max(1, _STEPS * sample // size)


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from all rows of ``docs`` with a language, or from about ``sample`` of each language where there are more."""
    known = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")).filter(
        F.col("lang").isNotNull())
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    grams_of, scripts_of = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPT_NAMES)))
    rare = [lang for lang in langs if sizes[lang] <= sample]
    hashed = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit(_STEPS - 1))
    chosen = F.col("lang").isin(rare)
    for lang in langs:
        if sizes[lang] > sample:
            chosen = chosen | ((F.col("lang") == lang) & (hashed < share(sample, sizes[lang])))
    counts = (known.filter(chosen).select("lang", "text").mapInArrow(_counts, "lang string, kind int, key int, n double")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    table = counts.toPandas()  # at most (BUCKETS + scripts) rows a language
    row = table["lang"].map({lang: at for at, lang in enumerate(langs)}).to_numpy(dtype=np.int64, na_value=0)
    for kind, into in enumerate((grams_of, scripts_of)):
        of = (table["kind"] == kind).to_numpy()
        into[row[of], table["key"].to_numpy()[of]] = table["n"].to_numpy()[of]
    return Model(langs, grams_of, scripts_of)


def viterbi(scores: np.ndarray, ids: np.ndarray, begins: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of every word. ``ids``: rows of ``scores``, document after document; all documents step together."""
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    path = np.zeros(len(ids), np.int16)
    steps = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(steps), side="left")  # documents with more words than t
    come = np.zeros((len(ids), scores.shape[1]), np.int16)  # where each word's languages come from
    sums = np.zeros((len(counts), scores.shape[1]), np.float32)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(steps):
        n = active[t]
        at = begins[:n] + t
        if t:
            before = sums[:n]
            top = before.argmax(axis=1)
            switched = before[np.arange(n), top] - penalty
            stays = before >= switched[:, None]
            come[at] = np.where(stays, own, top[:, None])
            sums[:n] = np.maximum(before, switched[:, None]) + scores[ids[at]]
        else:
            sums[:n] = scores[ids[at]]
    state = sums.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = begins[:n] + t
        path[at] = state[:n]
        state[:n] = come[at, state[:n]]
    # the first word's ``come`` is never used, as its document ends there
    return path


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}  # words as they stand in texts
        self.rows: dict[str, int] = {"": 0}  # their letters; row 0 is for words without any
        self.scores, self.sizes = np.zeros((1, len(self.model.langs)), np.float32), np.zeros(1, np.int64)
        self.uses = np.zeros((1, len(self.model.langs)), bool)

    def _learn(self, words: set[str]):
        missing = list(words.difference(self.known))
        if len(self.known) + len(missing) > REMEMBERED:
            self._forget()
            missing = list(words)
        if not missing:
            return
        stripped = letters(missing)
        new = list(set(stripped).difference(self.rows))
        if new:
            self.rows.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.scores = np.concatenate([self.scores, self.model.score(new)])
            self.uses = np.concatenate([self.uses, self.model.uses[Features(new).scripts]])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, new), np.int64, len(new))])
        self.known.update(zip(missing, map(self.rows.__getitem__, stripped)))

    def label(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """lang, score and spans ``lang:first word:end`` of each text."""
        langs = self.model.langs
        split = [text.split() for text in texts]
        if not langs:
            return [(UNDECIDED, 0.0, "")] * len(texts)
        self._learn(set().union(*split))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        begins = np.cumsum(counts) - counts
        known = self.known.__getitem__
        ids = np.fromiter((i for words in split for i in map(known, words)), np.int64, int(counts.sum()))
        path = viterbi(self.scores, ids, begins, counts)
        sizes = self.sizes[ids]
        out = []
        for begin, n in zip(begins.tolist(), counts.tolist()):
            states, weights = path[begin:begin + n], sizes[begin:begin + n]
            shares = np.bincount(states, weights, len(langs))
            total = shares.sum()
            if not total:
                out.append((UNDECIDED, 0.0, ""))
                continue
            cuts = np.r_[0, np.flatnonzero(states[1:] != states[:-1]) + 1, n]
            spans = ",".join(f"{langs[states[a]]}:{a}:{b}" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            top = int(shares.argmax())
            known = weights[(states == top) & self.uses[ids[begin:begin + n], top]].sum()
            out.append((langs[top], float(known / total), spans))
        return out


def _labelled(model: Model, carry: list[str], keep: float | None = None):
    """For ``mapInArrow``: with ``keep``, the rows decided with that score at least; else lang_pred, score, spans beside ``carry``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for begin, end in runs(texts, RUN):
                found, part = labeller.label(texts[begin:end]), batch.slice(begin, end - begin)
                if keep is not None:
                    yield part.filter(pa.array([lang != UNDECIDED and score >= keep for lang, score, _ in found], pa.bool_()))
                    continue
                columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *columns], [*carry, "lang_pred", "score", "spans"])

    return work


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans."""
    source = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col(text_column).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(_labelled(model, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, lang_pred string, score double, spans string")


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text (column ``text``) has a language with that score at least."""
    return docs.mapInArrow(_labelled(model, [], least), docs.schema)
