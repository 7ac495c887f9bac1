"""Token ids of whole texts by a tokenizer that drops white space, with a memory of words met before.

Texts stay in their Arrow buffers: words are found by their bytes, numbered by Arrow's dictionary encoding, and only the
different words of a slice become strings. Ids are then gathered from the memory, for all texts of the slice at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .token_counts import load_tokenizer

#: Fixed value: the split into pre-tokens that this encoder makes itself for plain words.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that a worker remembers at most; beyond that only those stay that are met again and again. About 150 bytes each.
REMEMBERED = 400_000
#: Bytes of text encoded at once, so that memory stays bounded; a longer text is a slice of its own.
SLICE = 2_000_000

#: Kinds of bytes. Others (capitals that stayed, apostrophes, control and further characters) make a word that isn't plain.
BETWEEN, LETTER, DIGIT, SIGN = 1, 2, 3, 4
KINDS = np.zeros(256, np.uint8)
KINDS[[32, 10]] = BETWEEN
KINDS[list(b"abcdefghijklmnopqrstuvwxyz")] = LETTER
KINDS[list(b"0123456789")] = DIGIT
KINDS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = SIGN


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, bounds of each text) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


class WordEncoder:
    """Encodes text by the words between its spaces and line feeds.

    Right for tokenizers that neither merge across white space nor keep it: the ids of a text are then those of its
    words, one after the other. A plain word has only lower-case letters up to U+00FF, digits and ASCII signs but the
    apostrophe. It is cut into its pre-tokens, which need no normalising, here; all other words go through the whole
    tokenizer as they stand. Letters are lowered first, as the tokenizer will do, except in texts with combining marks,
    which could join the lowered letter but not the capital. ``ids`` are little-endian unsigned 16-bit where the
    vocabulary allows it, else 32-bit.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tok = load_tokenizer(path)
        plan = json.loads(self.tok.to_str())
        steps = [s.get("type") for s in (plan["normalizer"] or {}).get("normalizers", [])]
        splits = (plan["pre_tokenizer"] or {}).get("pretokenizers", [])
        drops = [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": PRE_TOKENS} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        if steps != ["NFC", "Replace", "Lowercase"] or not drops or any(a["lstrip"] or a["rstrip"] for a in plan["added_tokens"]):
            raise ValueError("this tokenizer may treat white space as part of a token")
        suffix = plan["model"].get("end_of_word_suffix")
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.added = [a["content"].lower() for a in plan["added_tokens"]]
        #: A special string parts the words of one call, since nothing merges across it.
        self.parter = next((a["content"] for a in plan["added_tokens"] if a["special"]), None)
        #: The same model without normaliser, for pre-tokens with a space between; each ends in a token that ends a word.
        self.ends_word = np.zeros(self.tok.get_vocab_size(True), bool)
        self.ends_word[[i for t, i in self.tok.get_vocab(False).items() if suffix and t.endswith(suffix)]] = True
        plan |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, splits[1]]}}
        self.plain = Tokenizer.from_str(json.dumps(plan)) if suffix else None
        self.remembered = remembered
        #: Number of each word known, and for each number its place and length in the pool of ids, and how many slices had it.
        self.known: dict[str, int] = {}
        self.places, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)
        self.uses = np.zeros(0, np.int32)

    def _encoded(self, words: list[str], plain: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) of groups of ``words``, in order."""
        tok, parter = (self.plain, " ") if plain else (self.tok, self.parter)
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        for at in range(0, len(groups), 50):
            for x in tok.encode_batch_fast([parter.join(g) for g in groups[at : at + 50]], add_special_tokens=False):
                ids = np.array(x.ids, self.dtype)
                if plain:
                    yield ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)
                else:
                    cuts = np.flatnonzero(ids == tok.token_to_id(parter))
                    yield np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1

    def _learn(self, plain: list[str], other: list[str]) -> None:
        special = [w for w in other if not self.parter or any(a in w.lower() for a in self.added)]
        if special:
            other = [w for w in other if self.parter and not any(a in w.lower() for a in self.added)]
        parts = [(self.pool, self.sizes), *self._encoded(plain, True), *self._encoded(other, False)]
        parts += [(ids, np.array([len(ids)])) for w in special for ids in [np.array(self.tok.encode(w, add_special_tokens=False).ids, self.dtype)]]
        first = len(self.known)
        new = [*plain, *other, *special]
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.pool, self.sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        if not len(self.known) == first + len(new) == len(self.sizes) or self.sizes.sum() != len(self.pool):
            raise RuntimeError("the ids of some words can't be told apart")

    def _numbers(self, words: list[str], plain: np.ndarray) -> np.ndarray:
        """The number of each of the different ``words``; ``plain`` says which are single pre-tokens of plain words."""
        if len(self.known) + len(words) > self.remembered:
            # Those that several slices had stay, as many of them as half the room takes, and what this slice needs.
            least = next((u for u in range(2, 1 << 30) if np.count_nonzero(self.uses >= u) <= self.remembered // 2), 2)
            keep = self.uses >= least
            keep[[k for w in words if (k := self.known.get(w)) is not None]] = True
            at = np.flatnonzero(keep)
            number = np.cumsum(keep) - 1
            self.known = {w: int(number[k]) for w, k in self.known.items() if keep[k]}
            self.sizes, self.uses, self.pool = self.sizes[at], self.uses[at] - 1, self.pool[_runs(self.places[at], self.sizes[at])]
            self.places = np.cumsum(self.sizes) - self.sizes
        get = self.known.get
        found = np.array([get(w, -1) for w in words], np.int64)
        new = found < 0
        if new.any():
            new_plain, new_other = np.flatnonzero(new & plain), np.flatnonzero(new & ~plain)
            self._learn([words[k] for k in new_plain.tolist()], [words[k] for k in new_other.tolist()])
            found[new] = [self.known[words[k]] for k in np.flatnonzero(new).tolist()]
        self.uses[found] += 1
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids before each text and in all). A null is an empty text."""
        data, bounds = _bytes_of(pc.fill_null(texts, ""))
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(bounds), np.int64)
        lowered = data.tobytes().lower()
        low = np.frombuffer(bytearray(lowered), np.uint8)
        latin = np.flatnonzero(low == 0xC3)  # first byte of U+00C0 to U+00FF
        second = low[latin + 1]
        low[latin + 1] = np.where((second < 0x9F) & (second != 0x97), second + 0x20, second)
        whole = []  # texts with an added token are one word, as they were given
        if any(a.encode() in lowered for a in self.added):
            whole = [k for k in range(len(bounds) - 1) if any(lowered.find(a.encode(), bounds[k], bounds[k + 1]) >= 0 for a in self.added)]
        combining = np.flatnonzero((data & 0xFE) == 0xCC)  # first byte of U+0300 to U+037F
        for k in {*whole, *(np.searchsorted(bounds, combining, side="right") - 1).tolist()}:
            low[bounds[k] : bounds[k + 1]] = data[bounds[k] : bounds[k + 1]]
        kinds = KINDS[low]
        second = low[latin + 1]
        letters = latin[(second >= 0x9F) & (second != 0xB7)]
        kinds[letters] = kinds[letters + 1] = LETTER
        for k in whole:
            kinds[bounds[k] : bounds[k + 1]] = 0

        between = kinds == BETWEEN
        opens = np.empty(len(low), bool)  # a word between spaces
        opens[0], opens[1:] = True, between[:-1]
        opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        kept = ~between
        opens &= kept
        begin = np.flatnonzero(opens)
        strange = np.zeros(len(begin) + 1, bool)
        strange[np.searchsorted(begin, np.flatnonzero(kinds == 0), side="right") - 1] = True
        inner = np.flatnonzero(((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)) & kept[1:] & ~opens[1:]) + 1
        inner = inner[~strange[np.searchsorted(begin, inner, side="right") - 1]]
        opens[inner] = True
        cuts = np.flatnonzero(opens)
        plain = kinds[cuts] != 0
        strange_at = np.searchsorted(cuts, begin[strange[:-1]])
        plain[strange_at] = False
        offsets = np.append((np.cumsum(kept, dtype=np.int32) - 1)[cuts], np.int32(np.count_nonzero(kept))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(low[kept])).dictionary_encode()
        codes = words.indices.to_numpy()
        all_plain = np.ones(len(words.dictionary), bool)
        all_plain[codes[~plain]] = False
        numbers = self._numbers(words.dictionary.to_pylist(), all_plain)
        sizes = self.sizes[numbers].astype(np.int32)[codes]
        ids = self.pool[_runs(self.places[numbers].astype(np.int32)[codes], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return ids, before[np.searchsorted(cuts, bounds)]


def _runs(places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each place on, as many as its size."""
    before = np.cumsum(sizes) - sizes
    return np.repeat((places - before).astype(np.int32), sizes) + np.arange(int(sizes.sum()), dtype=np.int32)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded_slices(encoder: WordEncoder, texts: pa.Array, end_id: int, at_once: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids with ``end_id`` behind each text, ids before each text and in all) of runs of texts of about ``at_once`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    runs = np.cumsum(sizes) // at_once
    firsts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(texts)]
    for a, b in zip(firsts, firsts[1:], strict=False):
        if a < b:
            ids, before = encoder.encode(texts.slice(a, b - a))
            yield a, np.insert(ids, before[1:], encoder.dtype.type(end_id)), before + np.arange(len(before))
