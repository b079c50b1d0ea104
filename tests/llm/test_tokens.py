"""Packing, token files and sentence pieces against their libraries and plain versions."""

from __future__ import annotations

import bisect
import gc
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import packing, pieces, token_files, tokens

TEXTS = [
    "The quick brown fox, isn't it?",
    "",
    None,
    " \n\t ",
    "É́ x\x1cy z ΟΔΟΣ 'S don't <|endoftext|> İ K",
    "\x00  ﬁ 日本語 ٣ a. b., c.. é. x́, ª º ª. 1. the's. ǅ ß ẞ",
    "word " * 9000,
    "😀▁▁a  b\n\nc <s> <0x0A>",
    "foo <|endoftext|> bar<|startoftext|>Baz <|ENDOFTEXT|> <|endoftext|<|endoftext|>",
    "<|endoftext|><|startoftext|>é<|endoftext|>́x <|end oftext|>",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "y"), (3, "again three", "z"), (3, "again three", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT string").repartition(3), [(i, t) for i, t, _ in rows]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_encoder_is_the_library(library):
    own = tokens.WordEncoder(tokens.default_path(), most=4)
    for _ in range(2):
        for text, raw in zip(TEXTS, own.encode(TEXTS)):
            assert np.frombuffer(tokens.with_end(raw), "<u4").tolist() == library(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=30), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|"])), max_size=4).map("".join), max_size=4))
def test_word_encoder_on_any_text(library, texts):
    t = tokens.encoder(tokens.default_path())
    for text, raw in zip(texts, t.encode(texts)):
        assert [*np.frombuffer(raw, "<u4").tolist(), 1] == library(text)


def test_packed_sequences(docs, library):
    df, rows = docs
    got = packing.packed(df).collect()
    want = sorted((str(i), k // 4096, k, len(p := ids[k : k + 4096]), crc(p)) for i, t in rows for ids in [library(t)] for k in range(0, len(ids), 4096))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences(got, 4096)


def best_fit(lengths, capacity):
    """Sequences of plain best fit, longest first."""
    gaps, used = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        used += at == len(gaps)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - length)
    return used


def sequences(rows, capacity):
    """Pieces by sequence, after a look that they lie there without a gap and fit."""
    found = defaultdict(list)
    for r in rows:
        found[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return found


MIXES = {
    "ones": lambda rng: 1,
    "few sizes": lambda rng: rng.choice([1, 3, 15, 24, 34, 64]),
    "any": lambda rng: rng.randint(1, 64),
    "short": lambda rng: min(64, max(1, int(rng.lognormvariate(1.5, 1)))),
}


@pytest.mark.parametrize(("mix", "parts"), [("ones", 1), ("few sizes", 1), ("any", 1), ("short", 6), ("few sizes", 9)])
def test_packing_against_plain_best_fit(spark, monkeypatch, mix, parts):
    rng = random.Random(7)
    lengths = [MIXES[mix](rng) for _ in range(800)]
    df = spark.createDataFrame([(i % 100, 0, 0, x, 0) for i, x in enumerate(lengths)], packing.PIECES).repartition(3)
    monkeypatch.setattr(packing, "ROWS", 1000 // parts)
    rows = packing.pack(df, 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == sorted((i % 100, x) for i, x in enumerate(lengths))
    used, plain = len(sequences(rows, 64)), best_fit(lengths, 64)
    assert used <= plain + max(1, plain // 50)


def test_rounds_of_one_part_go_on_without_an_exchange(spark, monkeypatch):
    rng = random.Random(3)
    lengths = [rng.choice([MIXES["any"], MIXES["short"]])(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, 0, 0, x, 0) for i, x in enumerate(lengths)], packing.PIECES).repartition(40)
    monkeypatch.setattr(packing, "_round", lambda *_: pytest.fail("a round over several parts"))
    rows = packing.pack(df, 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert len(sequences(rows, 64)) <= best_fit(lengths, 64) + 1


def test_query_packs_as_well_as_best_fit(spark, sf_dir):
    rows = packing.op1_packing(spark, sf_dir).collect()
    assert len(sequences(rows, 4096)) <= best_fit([r["length"] for r in rows], 4096) + 1


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_ranks_are_a_plain_stack(seed):
    rng = random.Random(seed)
    parts, size = [], 1
    for p in range(12):
        items = [size + k for k in range(rng.randrange(6))]
        rooms = [size + 6] * rng.randrange(6)
        parts.append((p, len(rooms), size + 6, len(items), max(items, default=0)))
        size += rng.randrange(1, 4)
    free, want = [], []  # one item a gap
    for part, gaps, _, items, _ in parts:
        want += [((part, g), free.pop()) for g in range(min(gaps, len(free)))]
        free += [(part, k) for k in range(items)]
    runs = packing._carried(parts, 0)
    assert [((gp, g + k), (ip, i - 1 - k)) for gp, g, _, ip, i, n, _ in runs for k in range(n)] == want
    room, longest = ({p[0]: p[k] for p in parts} for k in (2, 4))
    seen = set()
    for gp, g, used, ip, i, n, each in packing._carried(parts, 100):
        assert ip < gp and each * longest[ip] <= room[gp] and used == -(-n // each) and n <= i
        own = {(gp, g + k, "gap") for k in range(used)} | {(ip, i - 1 - k, "item") for k in range(n)}
        assert not own & seen
        seen |= own


def test_token_files_read_back(docs, library):
    df, rows = docs
    got = token_files.token_files(df).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(x), crc(x)) for i, t in rows for x in [library(t)])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), min_size=1, max_size=4))
def test_segments_hold_any_ids(docs):
    ids = np.array([x for d in docs for x in d], "<u4")
    lengths = np.array([len(d) for d in docs], "<u4")
    s = token_files.Segment(token_files.encode_segment(np.arange(len(docs)), lengths, ids))
    assert s.ids().tolist() == ids.tolist() and s.lengths.tolist() == lengths.tolist()
    assert [x for i in range(s.blocks) for x in s.block(i).tolist()] == ids.tolist()


def test_segments_are_small_where_ids_are():
    ids = np.random.default_rng(1).integers(0, 16, 10_000).astype("<u4")
    ids[::200] = 40_000
    assert len(token_files.encode_segment(np.array([0]), np.array([len(ids)]), ids)) < 10_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(none).count() == token_files.token_files(none).count() == pieces.digests(none).count() == 0


@pytest.fixture(scope="module")
def piece_library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def test_pieces_are_the_library(docs, piece_library):
    df, rows = docs
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(df).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(x), sha(",".join(map(str, x))), sha(piece_library.decode(x))) for i, t in rows for x in [piece_library.encode(t or "")])
    assert got == want
    whole = pieces.encoded(df).collect()
    assert all(r["ids"] == piece_library.encode(r["decoded"]) or "▁" in r["decoded"] for r in whole if r["ids"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("the an in. ,\n▁éü日1"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_on_any_text(text):
    own = pieces.coder(pieces.default_path())
    ids = [i for u in own.encode([text])[0] for i in u[1]]
    assert ids == own.library.encode(text)
    assert own.decode(ids) == own.library.decode(ids)


def test_tables_agree_with_the_agenda_of_one():
    own, rng = pieces.coder(pieces.default_path()), random.Random(4)
    units = [" " * rng.randrange(3) + "".join(rng.choice("abdeilnorsthé,.") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    assert own.agendas(units) == [own.agenda(u) for u in units]


def test_a_difference_from_the_library_is_an_error():
    own = pieces.coder(pieces.default_path())
    with pytest.raises(ValueError, match="differ"):
        own.check([" the"], [[5]])


def test_common_words_are_given_to_the_library_by_their_pre_tokens(monkeypatch):
    own = tokens.WordEncoder(tokens.default_path())
    given, library = [], own._library
    monkeypatch.setattr(own, "_library", lambda words, whole: (given.extend(() if whole else words), library(words, whole)))
    texts = ["heshou$$$ \xc9an\xc9. \xdf.%%% a1b22c $ x_y-z 12.5% \xe9\xe9!! the. <|EndOfText|> ~~ \xdcber-\xc9t\xe9; $$$", "it's we'LL 'tis \xd7a \u0130x e\u0301. \u4e2d\u6587, a\u00a0b \u00bd1 \u00aab."]
    assert own.encode(texts) == [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert not set(texts[0].lower().encode().split()) & set(given)
    assert b"it's" in given


@pytest.mark.parametrize("query", [packing, token_files])
def test_words_of_a_batch_are_handled_once(monkeypatch, query):
    own, missing, asked = tokens.WordEncoder(tokens.default_path()), tokens.Recent.missing, []
    monkeypatch.setattr(tokens.Recent, "missing", lambda self, keys: asked.extend(keys) or missing(self, keys))
    monkeypatch.setattr(query, "encoder", lambda _: own)
    monkeypatch.setattr(query, "TaskContext", type("One", (), {"get": lambda: type("Part", (), {"partitionId": lambda: 0})}))
    batch = pa.record_batch({"doc_id": range(1500), "text": [f"the text{i % 7} and\x0b the TEXT{i % 7}. " for i in range(1500)]})
    run = packing._cut(tokens.default_path(), 4096, 1) if query is packing else token_files._written(tokens.default_path(), 1)
    assert sum(b.num_rows for b in run(iter([batch])))
    assert [asked.count(w) for w in (b"the", b"and", b"text3", b"text3.")] == [1] * 4


def test_word_encoder_on_arrow_arrays(library):
    own = tokens.WordEncoder(tokens.default_path())
    want = [np.array(library(t)[:-1], "<u4").tobytes() for t in TEXTS]
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(TEXTS, kind)
        assert own.encode(texts) == want
        assert own.encode(texts.slice(2, 3)) == want[2:5] and own.encode(texts.slice(8, 1)) == want[8:9]
        assert own.encode(texts.slice(0, 0)) == [] and own.encode(pa.nulls(2, kind)) == [b""] * 2


def test_kept_units_share_their_numbers_and_are_not_gone_through_for_cycles():
    tokens._held.clear()
    own = pieces.coder(pieces.default_path())
    assert gc.get_threshold() == tokens.LOOKS
    own.encode([" ".join(f"the{x}" for x in "abcdefghij")])
    kept = [ids for u, (_, ids) in own.units.new.items() if u.startswith(" the")]
    firsts = {i: x for ids in kept for i, x in zip(ids, ids)}
    assert len(kept) == 10 and all(x is firsts[x] for ids in kept for x in ids)
    gc.collect()
    assert not any(gc.is_tracked(ids) for ids in kept)
