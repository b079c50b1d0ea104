"""Token ids of whole texts by the tokenizers library, a word at a time.

The vocabulary's pre-tokenizer drops white space and never joins across it, and its normaliser lower-
cases, so a text's ids are those of its words one after the other. Added tokens (``<|endoftext|>``)
are cut out of a text first, as they are written, and have their own ids, as in the library. Each
Python worker keeps the ids of the words it has seen, in two generations of a bounded size, and gives
only new words to the library. Arrow splits many texts at once into words and tells which are equal, so
that Python handles a word once a batch.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import json
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS_KEPT = 300_000
END_ID = 1
MARKS = b".,;:!?"
#: Letters, marks and digits that the normaliser at most lower-cases, without the apostrophe, which can join a letter.
COMMON = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
#: A word of these, in small letters, as the vocabulary's pre-tokenizer splits it.
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: The pre-tokenizer's pattern, as the vocabulary's file has it.
SPLIT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words given to the library at once.
GIVEN = 1024
#: Texts that are encoded at once, at most.
BATCH = 2048


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_held: dict[tuple, object] = {}
#: New containers until Python looks for cycles: what is kept has none, and would be gone through again and again.
LOOKS = (100_000, 20, 20)


def held(key: tuple, make):
    """An object kept by this Python process, so that the tasks that it runs share it.

    Only one is kept: what an operator held goes, and its memory back to the system, when the process
    comes to work for another.
    """
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)
        gc.set_threshold(*LOOKS)
        _held[key] = make()
    return _held[key]


class Recent:
    """A mapping of bounded size: entries not asked for while ``most`` others came are forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> None:
        """Between batches: make the entries so far the old generation if they are many."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}

    def missing(self, keys: set) -> list:
        """Those of ``keys`` without a value; the others are safe in ``new`` from now on."""
        lacking = keys.difference(self.new)
        back = [k for k in lacking if k in self.old]
        self.new.update([(k, self.old[k]) for k in back])
        return [*lacking.difference(back)]


class WordEncoder:
    """``encode(texts)``: each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what is left of a text when they are cut out is ordinary
        if SPLIT not in self.tokenizer.to_str():
            raise ValueError("this vocabulary has a pre-tokenizer of another pattern")
        self.model, self.letters = self.tokenizer.model, _letters()
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("this vocabulary has added tokens that are not found as they are written")
        self.added = {t.content.encode(): i.to_bytes(4, "little") for i, t in added.items()}
        self.start = os.path.commonprefix([*self.added]) or b""
        self.cuts = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")" if self.added else b"(?!)")
        self.words = Recent(most)

    def _library(self, words: list[bytes], whole: bool) -> None:
        """Give words to the library. Those that are one pre-token each need no normaliser and no splitting and go to its
        model; the others go many at a time, and the words of what it finds tell which ids are whose."""
        new = self.words.new
        if whole:
            tokenize, number = self.model.tokenize, struct.Struct("<I").pack
            for w in words:
                text = w.decode() if w.isascii() else w.decode("latin-1").translate(self.letters)
                new[w] = b"".join([number(t.id) for t in tokenize(text)])
            return
        for i in range(0, len(words), GIVEN):
            part = words[i : i + GIVEN]
            found = self.tokenizer.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), "right") * 4).tolist()
            new.update(zip(part, (raw[a:b] for a, b in zip([0, *ends], ends))))

    def _learn(self, todo: list[bytes]) -> None:
        """Ids of new words. Words of common letters, marks and digits are learned by their pre-tokens: a single mark
        after a letter is one of its own, the others are split as the library does."""
        ended = [w for w in todo if len(w) > 1 and w[-1] in MARKS and 97 <= w[-2] <= 122]
        words = set(todo).difference(ended)
        words.update(self.words.missing({w[:-1] for w in ended} | {w[-1:] for w in ended}))
        whole, split, others = [], {}, []
        for w in words:
            if w.isalpha() or _plain(text := w.decode()):
                whole.append(w)
            elif COMMON.fullmatch(text):
                split[w] = [x.encode() for x in PARTS.findall(text.lower())]
            else:
                others.append(w)
        parts = set(itertools.chain.from_iterable(split.values()))
        parts.difference_update(whole)
        whole += self.words.missing(parts)
        self._library(whole, True)
        self._library(others, False)
        get = self.words.new.__getitem__
        self.words.new.update([(w, b"".join(map(get, x))) for w, x in split.items()])
        self.words.new.update([(w, get(w[:-1]) + get(w[-1:])) for w in ended])

    def _ordinary(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts without added tokens."""
        rows = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        words = rows.flatten().dictionary_encode()
        own = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        self.words.turn()
        self.words.new[b""] = b""  # before a text's first white space and after its last
        found = [*map(self.words.new.get, own)]
        self._learn(self.words.missing({w for w, x in zip(own, found) if x is None}))
        found = [self.words.new[w] if x is None else x for w, x in zip(own, found)]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64) if len(ids) else np.zeros(1, np.int64)
        raw = memoryview(raw or b"")
        at = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(rows).to_numpy())])].tolist()
        return [raw[a:b].tobytes() for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        odd = {}  # texts with added tokens: ordinary, added, ordinary ...
        if self.added:
            for i in pc.indices_nonzero(pc.match_substring(texts, self.start.decode(errors="ignore")).fill_null(False)).to_pylist():
                if len(parts := self.cuts.split(texts[i].as_py().encode())) > 1:
                    odd[i] = parts
        if not odd:
            return self._ordinary(texts)
        ids = self._ordinary(pc.if_else(pa.array([i in odd for i in range(len(texts))]), "", texts))
        between = iter(self._ordinary(pa.array([x.decode() for parts in odd.values() for x in parts[::2]], pa.large_string())))
        for i, parts in odd.items():
            ids[i] = b"".join(self.added[x] if k % 2 else next(between) for k, x in enumerate(parts))
        return ids


def _letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary's byte-level pre-tokens; those of printing ASCII are themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(others)}


def _plain(word: str) -> bool:
    """Only letters, which the normaliser leaves alone."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


def encoder(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))


def with_end(ids: bytes, end_id: int = END_ID) -> bytes:
    return ids + end_id.to_bytes(4, "little")
