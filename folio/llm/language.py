"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters, with the marks that follow them. Its scripts leave as candidates the
languages that the labelled texts showed in those scripts. A word's score for a language is the sum of the logarithms of its letter
n-grams' shares there. The best sequence of labels under a penalty for each switch gives spans; a
text's language is the one with the most letters.

A text's constant labelling is the best one if no stretch of words gains more than the penalty even if
each of its words had the best of the other languages, as any stretch in other languages costs one
switch at least. That is tested on whole arrays; texts that fail it go through Viterbi word by word.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, numbered, pick, slices
from folio.llm.tokens import held

#: Labelled texts of a language that are drawn on average (by a hash of their id) to learn from.
SAMPLE = 2000
#: Languages whose counts a task holds at once; those of more are handed on in parts.
HELD_LANGUAGES = 64
ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
OUT = -20.0
UNDETERMINED = "und"

#: First and last code points of scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Indic": [(0x900, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}
OTHER = len(SCRIPTS) + 1
MARK = 128


def _classes() -> np.ndarray:
    """By code point: 0 no part of a word, else its script, and MARK above it for marks."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    found = np.array([OTHER if k in "LM" else 0 for k in kinds], np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            own = found[a : b + 1]
            own[own > 0] = k
    return found | np.array([MARK if k == "M" else 0 for k in kinds], np.uint8)


def classes() -> np.ndarray:
    return held(("scripts",), _classes)


def _points(text: str) -> np.ndarray:
    """Code points of the text in lower case, one for each of its characters."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


def _in_words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each place its script, 0 outside words, and whether a word has it: marks before any letter are in none."""
    kind = classes()[points]
    inside = kind > 0
    mark = kind >= MARK
    for i in np.flatnonzero(mark & ~np.concatenate([[False], inside[:-1]])).tolist():
        while i < len(mark) and mark[i]:
            inside[i] = False
            i += 1
    return np.where(inside, kind & (MARK - 1), 0), inside


@dataclass
class Words:
    """The words of some texts: grams[k] and gram_word[k] for each order, script, letters and text by word."""

    grams: list[np.ndarray]
    gram_word: list[np.ndarray]
    script: np.ndarray
    letters: np.ndarray
    text: np.ndarray
    start: np.ndarray


def words(texts: list[str]) -> Words:
    """Words with their n-grams, a boundary on both sides, hashed to BUCKETS."""
    parts = [_points(t) for t in texts]
    sizes = np.array([len(p) + 2 for p in parts])
    gap = np.zeros(1, np.uint32)
    points = np.concatenate([x for p in parts for x in (gap, p, gap)]) if parts else gap[:0]
    kind, inside = _in_words(points)
    points = np.where(inside, points, 0).astype(np.uint64)
    first = np.flatnonzero(inside & ~np.roll(inside, 1))
    last = np.flatnonzero(inside & ~np.roll(inside, -1))
    offset = np.cumsum(sizes) - sizes
    text = np.searchsorted(offset, first, "right") - 1
    of = np.cumsum(np.bincount(first, minlength=len(points)), dtype=np.int32) - 1  # the word that a place is in, or follows
    mixed = points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)
    size, grams, gram_word = len(points), [], []
    h, within = mixed, None  # of n-grams by their first place; are all places but the first and last inside?
    for n in range(2, max(ORDERS) + 1):
        room = max(0, size - n + 1)
        h = h[:room] * np.uint64(0x100000001B3) + mixed[n - 1 : n - 1 + room]
        ok = inside[:room] | inside[n - 1 : n - 1 + room]
        if n > 2:
            within = inside[1 : 1 + room] if within is None else within[:room] & inside[n - 2 : n - 2 + room]
            ok = ok & within
        if n in ORDERS:
            at = np.flatnonzero(ok)
            x = h[at]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x >>= np.uint64(48)
            grams.append(x.astype(np.int32))
            gram_word.append(of[at + 1])
    return Words(grams, gram_word, kind[first], last - first + 1, text, first - offset[text] - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: (lang, counts of every n-gram of every order, words by script) of the part."""

    def handed(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, row in totals.items():
            yield pa.record_batch([pa.array([name]), pa.array([zlib.compress(row.astype("<i8").tobytes(), 1)])], ["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    for b in slices(batches):
        langs = b["lang"].to_pylist()
        w = words([t or "" for t in b["text"].to_pylist()])
        codes = {name: i for i, name in enumerate(dict.fromkeys(langs))}
        lang = np.array([codes[x] for x in langs])
        for name, code in codes.items():
            own = lang[w.text] == code
            row = [np.bincount(g[own[gw]], minlength=BUCKETS) for g, gw in zip(w.grams, w.gram_word)]
            row = np.concatenate([*row, np.bincount(w.script[own], minlength=OTHER + 1)]).astype(np.int64)
            totals[name] = totals.get(name, 0) + row
            if len(totals) >= HELD_LANGUAGES:
                yield from handed(totals)
                totals = {}
    yield from handed(totals)


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in rows["counts"])
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


@dataclass
class Model:
    languages: list[str]
    weights: list[np.ndarray]  # by order: languages by BUCKETS
    allowed: np.ndarray  # scripts by languages

    def scores(self, w: Words) -> np.ndarray:
        """Words by languages."""
        n = len(w.script)
        found = np.zeros((len(self.languages), n), np.float64)
        for table, g, gw in zip(self.weights, w.grams, w.gram_word):
            if len(g):
                at = np.flatnonzero(np.diff(gw, prepend=-1))
                own = gw[at]
                for k, weights in enumerate(table):
                    found[k, own] += np.add.reduceat(weights[g], at)
        return found.T + np.where(self.allowed, 0.0, OUT)[w.script]


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """From rows (doc_id, text, lang): on average ``sample`` texts of each language, drawn by a hash of their id.

    Every language that a row has is learned. The n-gram tables have a fixed size for each; those of a part add up on
    the executors, a language a task.
    """
    sizes = labelled.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], [], np.zeros((OTHER + 1, 0), bool))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = labelled.where(draw < share[F.col("lang")]).select("text", "lang")
    rows = drawn.mapInArrow(_counted, "lang string, counts binary").groupBy("lang").applyInPandas(_summed, "lang string, counts binary").collect()
    tables = {r["lang"]: r["counts"] for r in rows}
    empty = zlib.compress(np.zeros(BUCKETS * len(ORDERS) + OTHER + 1, "<i8").tobytes(), 1)
    size, own = len(ORDERS) * BUCKETS, [tables.get(x, empty) for x in langs]  # compressed: one at a time is opened

    def logs(packed: bytes) -> np.ndarray:
        counts = np.frombuffer(zlib.decompress(packed), "<i8")[:size].reshape(len(ORDERS), BUCKETS) + SMOOTH
        return np.log(counts / counts.sum(axis=1, keepdims=True))

    mean = sum(map(logs, own)) / len(langs)
    weights = [np.empty((len(langs), BUCKETS), np.float32) for _ in ORDERS]
    for i, packed in enumerate(own):
        for table, row in zip(weights, logs(packed) - mean):
            table[i] = row
    scripts = np.stack([np.frombuffer(zlib.decompress(x), "<i8")[size:] for x in own], axis=1)
    allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
    return Model(langs, weights, allowed | ~allowed.any(axis=1, keepdims=True))


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The labels with the highest sum of scores, less ``switch`` for each change of label.

    Numbers of a word are a few Python floats; the sums are kept, and the way back is found from them.
    """
    rows = scores.tolist()
    best = rows[0]
    sums = [best]
    for row in rows[1:]:
        least = max(best) - switch
        best = [(b if b >= least else least) + x for b, x in zip(best, row)]
        sums.append(best)
    path, label = [0] * len(rows), 0
    for t in range(len(rows) - 1, -1, -1):
        best = sums[t]
        top = max(best)
        if t == len(rows) - 1 or best[label] < top - switch:
            label = best.index(top)
        path[t] = label
    return np.array(path, np.int32)


def labels(scores: np.ndarray, switch: float) -> np.ndarray:
    """As ``viterbi``, at once where one label wins throughout."""
    top = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int32)
    others = scores.copy()
    others[:, top] = -np.inf
    gain = np.concatenate([[0.0], (others.max(axis=1) - scores[:, top]).cumsum()])
    if (gain - np.minimum.accumulate(gain)).max() <= switch:
        return np.full(len(scores), top, np.int32)
    return viterbi(scores, switch)


#: Characters that are worked on at once; longer texts are cut between words, longer words anywhere.
AT_ONCE = 1 << 18


def _cut(text: str, most: int | None = None) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, in parts of at most AT_ONCE (or ``most``) characters that end between words where they can."""
    most, at = most or AT_ONCE, 0
    while len(text) - at > most:
        end = at + most
        while end > at and unicodedata.category(text[end - 1])[0] in "LM":
            end -= 1
        end = end if end > at else at + most
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def _scored(model: Model, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text's words: scores, letters and places, found for some texts at a time."""
    most = max(1, AT_ONCE * 64 // max(64, len(model.languages)))  # scores are words by languages
    parts = [(k, at, part) for k, t in enumerate(texts) for at, part in _cut(t, most)]
    found: list[list] = [[] for _ in texts]
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j][2]) <= most):
            size += len(parts[j][2])
            j += 1
        w = words([p for _, _, p in parts[i:j]])
        scores, edges = model.scores(w), np.searchsorted(w.text, np.arange(j - i + 1))
        for (k, at, _), a, b in zip(parts[i:j], edges[:-1], edges[1:]):
            found[k].append((scores[a:b], w.letters[a:b], w.start[a:b] + at))
        i = j
    return [tuple(map(np.concatenate, zip(*f))) for f in found]


def label_texts(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
    """Of each text: language, share of its letters that have it, spans (start, end, lang) in characters."""
    if not model.languages:
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    out = []
    for scores, size, start in _scored(model, [t or "" for t in texts]):
        if not len(scores):
            out.append((UNDETERMINED, 0.0, []))
            continue
        path = labels(scores, switch)
        by = np.bincount(path, weights=size, minlength=len(model.languages))
        cuts = np.flatnonzero(np.diff(path, prepend=-1))
        ends = [*(cuts[1:] - 1), len(path) - 1]
        spans = [{"start": int(start[i]), "end": int(start[j] + size[j]), "lang": model.languages[path[i]]} for i, j in zip(cuts, ends)]
        out.append((model.languages[int(by.argmax())], float(by.max() / by.sum()), spans))
    return out


SPANS = "array<struct<start: int, end: int, lang: string>>"


def labelled_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows to learn from: a non-null language, and crc32 of the id as text not 2 modulo 4."""
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    return rows.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_udf(spark: SparkSession, model: Model):
    """A function on a text column: its language."""
    known = spark.sparkContext.broadcast(model)  # a fixed size for each language

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        found: list[str] = []
        for i in range(0, len(texts), 64):
            found += [lang for lang, _, _ in label_texts(known.value, texts.slice(i, 64).to_pylist())]
        return pa.array(found, pa.string())

    return run


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, score, spans of every row's whole text.

    A null text, or one without a letter, is ``und`` with score 0 and no spans; so is every text if
    nothing was learned. Repeated ids and rows keep a row each; other columns are not read.
    """

    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in slices(batches, 64, 1 << 20):
            found = label_texts(known.value, b["text"].to_pylist())
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), kind))]
            yield pa.record_batch([b["doc_id"], *cols], ["doc_id", "lang", "score", "spans"])

    rows = pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, f"doc_id long, lang string, score double, spans {SPANS}")


def lettered(texts: pa.Array) -> pa.Array:
    """Does a text have a letter? Decided by itself, whatever was learned."""
    found = []
    for i in range(0, len(texts), 64):
        for t in texts.slice(i, 64).to_pylist():
            found.append(bool(_in_words(_points(t or ""))[1].any()))
    return pa.array(found, pa.bool_())


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text is null or has no letter, all columns as they were.

    Repeated ids and rows are told each for itself, and further columns may have any names.

    With a model these are the rows that are ``und``; where nothing was learned, every text is, and only
    its letters count.
    """
    model = learn(labelled_rows(docs, id_col, text_col, lang_col))
    rows, names = numbered(docs)
    text = F.col(f"c{names.index(text_col)}")
    stays = language_udf(docs.sparkSession, model)(text) != UNDETERMINED if model.languages else F.arrow_udf(lettered, "boolean")(text)
    return rows.where(stays).toDF(*names)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, learn(labelled_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


QUERIES = {"op10_language": op10_language}
ORACLES: dict[str, str] = {}
