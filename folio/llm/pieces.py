"""SentencePiece encoding and decoding of merge-type vocabularies.

Symbols start as characters. An agenda holds the adjacent pairs whose joined piece is in the
vocabulary, ordered by score (higher first) and place (left first); the best pair is joined and its
new neighbours are put on the agenda, until it is empty. Characters outside the vocabulary become
byte pieces.

No piece has a space mark after another character, a full stop or comma after a Latin letter, or a line end,
so no join crosses there: a text's ids are those of its units (a run of spaces with the word after it,
what a stop or comma starts after a word, or a line end). A vocabulary with such pieces is refused. Each Python worker keeps the units it has
seen, in two generations of a bounded size; the agenda runs for new ones. All new units of an Arrow
batch are checked against the sentencepiece library: any difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import documents, pick, slices
from folio.llm.tokens import Recent, held

MARK = "▁"
UNITS_KEPT = 400_000
TABLE_WIDTH, TABLE_ROWS = 32, 4096
NEVER = 1 << 40
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
UNIT = re.compile(rf"\n| *{LETTER}+(?=[.,])| *[^ \n]+| +")
ENDED = re.compile(rf"{LETTER}[.,]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCoder:
    """Encodes and decodes with the vocabulary of a sentencepiece model file."""

    def __init__(self, path: str, most: int = UNITS_KEPT):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        own = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        self.ids = {self.library.id_to_piece(i): i for i in own}
        scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        places = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {p: places[x] for p, x in scores.items()}
        self.known = {p for p in self.ids if len(p) == 1}
        pairs = [(self.ids[p[:i]], self.ids[p[i:]], self.ranks[p], self.ids[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        pairs = np.array(sorted((a << 32 | b, r, i) for a, b, r, i in pairs) or [(-1, 0, 0)], np.int64)
        self.pair_keys, self.pair_ranks, self.pair_ids = np.ascontiguousarray(pairs.T)
        self.bytes = {int(self.library.id_to_piece(i)[3:-1], 16): i for i in range(n) if self.library.is_byte(i)}
        self.surface = {i: p.replace(MARK, " ") for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.library.unk_id()
        if any(MARK in p.lstrip(MARK) or "\n" in p or ENDED.search(p) for p in self.ids):
            raise ValueError("this vocabulary has pieces that cross units")
        self.one = list(range(n))
        self.decimal = list(map(str, self.one))
        self.units = Recent(most)

    def agenda(self, unit: str) -> list[int]:
        """The ids of one unit, its spaces given as spaces.

        An entry of the agenda is a number: the rank of the joined piece's score, then the place of its
        left symbol. An entry whose pair has changed meanwhile no longer has that rank and is passed over.
        """
        symbols: list[str | None] = list(unit.replace(" ", MARK))
        n, rank = len(symbols), self.ranks.get
        todo = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(todo)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while todo:
            entry = heapq.heappop(todo)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbols[i] is None or j == n or rank(joined := symbols[i] + symbols[j]) != entry >> 32:
                continue
            symbols[i], symbols[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heapq.heappush(todo, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + joined)) is not None:
                heapq.heappush(todo, r << 32 | h)
        found: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if s in self.ids:
                found.append(self.ids[s])
            elif self.bytes:
                found += [self.bytes[b] for b in s.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return found

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of ids: the rank and the id of the joined piece; rank NEVER where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], NEVER), self.pair_ids[at]

    def _agenda_table(self, units: list[str]) -> list[list[int]]:
        """The agenda of many short units of known characters at once: a row a unit, with the rank of each
        adjacent pair by its place. Every round joins the best pair of each row, of equal ones the left one."""
        n, width = len(units), max(map(len, units))
        ids = np.full((n, width), -1, np.int64)
        flat = np.array([self.ids[c] for u in units for c in u], np.int64)
        ids[np.arange(width) < np.array([len(u) for u in units])[:, None]] = flat
        nothing, never = np.full((n, 1), -1), np.full((n, 1), NEVER)
        ranks = np.concatenate([self._joined(ids[:, :-1], ids[:, 1:])[0], never], axis=1)
        places, rows, out = np.arange(width), np.arange(n), [[]] * n
        while True:
            own = np.arange(len(rows))
            best = ranks.argmin(axis=1)
            live = ranks[own, best] < NEVER
            for k, row in zip(rows[~live].tolist(), ids[~live].tolist()):
                out[k] = row[: row.index(-1)] if -1 in row else row
            if not live.any():
                return out
            ids, ranks, best, rows = ids[live], ranks[live], best[live], rows[live]
            own = own[: len(rows)]
            joined = self._joined(ids[own, best], ids[own, best + 1])[1]
            moved = places + (places > best[:, None])
            ids = np.take_along_axis(np.concatenate([ids, nothing[: len(rows)]], axis=1), moved, axis=1)
            ranks = np.take_along_axis(np.concatenate([ranks, never[: len(rows)]], axis=1), moved, axis=1)
            ids[own, best] = joined
            after = np.where(best + 1 < width, ids[own, np.minimum(best + 1, width - 1)], -1)
            ranks[own, best] = self._joined(joined, after)[0]
            left = np.maximum(best - 1, 0)
            ranks[own, left] = np.where(best > 0, self._joined(ids[own, left], joined)[0], ranks[own, left])

    def agendas(self, units: list[str]) -> list[list[int]]:
        """The ids of units: short ones of known characters in tables, the others one by one."""
        given = [u.replace(" ", MARK) for u in units]
        order = np.argsort(np.fromiter(map(len, given), np.int64, len(given)), kind="stable").tolist()
        known = self.known.issuperset
        short = [k for k in order if len(given[k]) <= TABLE_WIDTH and known(given[k])]
        out: list = [None] * len(units)
        for i in range(0, len(short), TABLE_ROWS):
            part = short[i : i + TABLE_ROWS]
            for k, ids in zip(part, self._agenda_table([given[k] for k in part])):
                out[k] = ids
        return [self.agenda(u) if ids is None else ids for u, ids in zip(units, out)]

    def check(self, units: list[str], found: list[list[int]]) -> None:
        """Hold units' ids against the library, which puts a space before every text.

        A unit that starts without a space is checked as one after a line end.
        """
        line = [*self.agenda(" "), *self.agenda("\n")]
        plain = [(u[1:], i, u) if u[0] == " " else (f"\n{u}", [*line, *i], u) for u, i in zip(units, found) if u.strip(" ")]
        for (_, own, unit), other in zip(plain, self.library.encode([t for t, _, _ in plain], num_threads=1)):
            if own != other:
                raise ValueError(f"ids differ from the library's for {unit!r}: {own}, {other}")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces one after the other, runs of byte pieces as UTF-8, without the first space."""
        parts: list[str] = []
        for is_byte, run in itertools.groupby(ids, self.byte_of.__contains__):
            parts.append(bytes(self.byte_of[i] for i in run).decode(errors="replace") if is_byte else "".join(self.surface.get(i, " ⁇ ") for i in run))
        return "".join(parts).removeprefix(" ")

    def encode(self, texts: list[str | None]) -> list[list[tuple[str, tuple[int, ...]]]]:
        """Each text's units as (their ids in decimals joined by commas, their ids)."""
        rows = [UNIT.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        self.units.turn()
        todo = self.units.missing(set(itertools.chain.from_iterable(rows)))
        found = self.agendas(todo)
        self.check(todo, found)
        one, text = self.one.__getitem__, self.decimal.__getitem__  # units share their numbers
        self.units.new.update([(u, (",".join(map(text, i)), tuple(map(one, i)))) for u, i in zip(todo, found)])
        get = self.units.new.__getitem__
        return [list(map(get, r)) for r in rows]


def coder(path: str) -> PieceCoder:
    return held(("pieces", path), lambda: PieceCoder(path))


def _coded(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for b in slices(batches):
            coded = own.encode(b["text"].to_pylist())
            ids = [",".join([u[0] for u in units]) for units in coded]
            numbers = [list(itertools.chain.from_iterable([u[1] for u in units])) for units in coded]
            texts = [own.library.decode(x) if x else "" for x in numbers]
            if keep:
                yield pa.record_batch([b["doc_id"], pa.array(numbers, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                continue
            cols = [pa.array([len(x) for x in numbers], pa.int64())]
            cols += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in c]) for c in (ids, texts)]
            yield pa.record_batch([b["doc_id"], *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return pick(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))


def encoded(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: the ids of whole texts and the text that the library decodes from them.

    A null or empty text has no ids and decodes to an empty text. Rows are coded one by one, so that
    repeated ids and rows keep a row each. Other columns are not read.
    """
    return _rows(df, id_col, text_col).mapInArrow(_coded(path or default_path(), True), "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encoded``, with the number of ids and SHA-256 of ids and text in place of them."""
    return _rows(df, id_col, text_col).mapInArrow(_coded(path or default_path(), False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
ORACLES: dict[str, str] = {}
