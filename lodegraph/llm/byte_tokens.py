"""Byte-level BPE ids by the tokenizers library, asked once for each distinct piece of text."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A blank before a visible character always begins a new pre-token, so text may be cut there.
_CUT = re.compile(r" (?=\S)")
#: Texts, in RE2's writing, with a blank that is no cut.
_BLANKS = r" (?:[\t-\r\x1c-\x1f\x{85}\p{Z}]|\z)"
#: Characters whose run after a letter is one pre-token; an apostrophe may begin a contraction.
_STOPS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
# letters below U+0250 are letters in every version of Unicode's tables
_WORD = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+[!-&(-/:-@\[-`{-~]*"
_PLAIN, _LINES = rf"\A{_WORD}\z", rf"\A{_WORD}\n{_WORD}\z"
#: Bytes that UTF-8 never has.
_NO_BYTES = (*range(0xFF, 0xF4, -1), 0xC1, 0xC0)
#: Pieces whose ids are put together at a time, and ids that the memory may have room for without need.
_SLOTS, _SPARE = 1 << 16, 1 << 22


class ByteTokens:
    """Encodes texts as `Tokenizer.encode_batch(texts, add_special_tokens=False)` does.

    For byte-level BPE with its own splitting pattern. Texts are cut before blanks that
    begin a pre-token, and the library encodes each distinct piece once, many of them
    joined into one string: a token never crosses a cut, so its bytes tell which piece
    it is from. A piece of plain letters, also with stops behind, has one pre-token or two;
    its letters go to the library's model at once, joined by a byte that no merge knows.
    Texts with an added token in them go to the library whole. At most `cache`
    pieces of `cache_chars` characters in all are remembered, then the memory starts anew; pieces
    of over `long` characters, as in scripts without blanks, are not.
    """

    def __init__(self, path: str, cache: int = 1_000_000, cache_chars: int = 12_000_000, long: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.model, self.special, self.lengths, self.as_bytes, self.between, self.between_id = _tables(path, os.stat(path).st_mtime_ns)
        self.cache, self.cache_chars, self.long = cache, cache_chars, long
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begun: dict[str, int] = {}
        self.stops: dict[str, int] = {}
        self.chars = self.n_ids = self.n_slots = 0
        self.ids, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> range:
        """Slots for entries that lie one behind the other in `ids`."""
        a, b = self.n_ids, self.n_slots
        self.n_ids, self.n_slots = a + len(ids), b + len(counts)
        self.ids = _room(self.ids, self.n_ids)
        self.first, self.count = _room(self.first, self.n_slots), _room(self.count, self.n_slots)
        self.ids[a : self.n_ids] = ids
        self.count[b : self.n_slots] = counts
        self.first[b : self.n_slots] = a + np.cumsum(counts) - counts
        return range(b, self.n_slots)

    def _ids_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slots, one behind the other, and how many each has."""
        counts = self.count[slots]
        shift = self.first[slots] - np.cumsum(counts) + counts
        at = np.repeat(shift, counts)
        at += np.arange(len(at))
        return self.ids[at], counts

    def _whole(self, texts: list[str]) -> range:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._keep(_flat(lists), np.array([len(x) for x in lists], dtype=np.int64))

    def _joined(self, pieces: list[str]) -> range:
        """Slots of pieces, each with the blank before it."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([" " + " ".join(x) for x in _chunks(pieces, 1024)], add_special_tokens=False)]
        ids = _flat(lists)
        ends = np.cumsum([len(x.encode()) + 1 for x in pieces])
        return self._keep(ids, np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, side="right"), prepend=0))

    def _words(self, words: list[str], blank: bytes) -> range:
        """Slots of words of plain letters, each with `blank` before it."""
        texts = []
        for some in _chunks(words, 256):
            raw = blank + " ".join(some).encode().replace(b" ", self.between + blank) + self.between
            texts.append(self.as_bytes[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le"))
        ids = _flat([e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        ends = ids == self.between_id
        return self._keep(ids[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1)

    def _look_up(self, names: list[str], memory: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of names, negative for new ones, and where these are."""
        slots = np.fromiter(map(memory.get, names, repeat(-1)), np.int64, len(names))
        return slots, np.flatnonzero(slots < 0)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Slots of new pieces."""
        plain, lines = (pc.match_substring_regex(pieces, x).to_numpy(zero_copy_only=False) & bool(self.between) for x in (_PLAIN, _LINES))
        other = ~(plain | lines)
        slots = np.empty(len(pieces), np.int64)
        names = _strings(pieces.filter(pa.array(other)))
        slots[other] = self._remember(names, self._joined(names), self.known)
        slots[plain] = self._plain(pieces.filter(pa.array(plain)), self.known, b" ")
        if lines.any():
            # the line's end is a pre-token of its own, and what follows has no blank before it
            pieces = pieces.filter(pa.array(lines))
            sides = pc.split_pattern(pieces, "\n").flatten()
            left, right = (self._distinct(sides.take(pa.array(np.arange(k, len(sides), 2))), *memory) for k, memory in enumerate(((self.known, b" "), (self.begun, b""))))
            slots[lines] = self._put_together(_strings(pieces), [left, self._stops(["\n"]).repeat(len(left)), right], self.known)
        return slots

    def _distinct(self, pieces: pa.Array, memory: dict[str, int], blank: bytes) -> np.ndarray:
        """Slots of pieces of plain letters and stops, of which some may be known or alike."""
        pieces = pieces.dictionary_encode()
        slots, new = self._look_up(_strings(pieces.dictionary), memory)
        slots[new] = self._plain(pieces.dictionary.take(pa.array(new)), memory, blank)
        return slots[pieces.indices.to_numpy()]

    def _plain(self, pieces: pa.Array, memory: dict[str, int], blank: bytes) -> np.ndarray:
        """Slots of new pieces of plain letters and stops, with `blank` before them."""
        cores = pc.ascii_rtrim(pieces, characters=_STOPS)
        # a word is known also without its stops, as the piece that it is
        words = cores.dictionary_encode()
        names = _strings(words.dictionary)
        word, new = self._look_up(names, memory)
        fresh = [names[i] for i in new.tolist()]
        word[new] = self._remember(fresh, self._words(fresh, blank), memory)
        word = word[words.indices.to_numpy()]
        stopped = np.flatnonzero(pc.binary_length(cores).to_numpy() < pc.binary_length(pieces).to_numpy())
        if len(stopped):
            texts, sizes = _strings(pieces.take(pa.array(stopped))), pc.utf8_length(cores).to_numpy()[stopped].tolist()
            ends = self._stops([x[n:] for x, n in zip(texts, sizes, strict=True)])
            word[stopped] = self._put_together(texts, [word[stopped], ends], memory)
        return word

    def _stops(self, ends: list[str]) -> np.ndarray:
        """Slots of pre-tokens without letters."""
        fresh = list({x: None for x in ends if x not in self.stops})
        self._remember(fresh, self._whole(fresh), self.stops)
        return self._look_up(ends, self.stops)[0]

    def _put_together(self, names: list[str], parts: list[np.ndarray], memory: dict[str, int]) -> range:
        ids, counts = self._ids_of(np.stack(parts, axis=1).ravel())
        return self._remember(names, self._keep(ids, counts.reshape(-1, len(parts)).sum(axis=1)), memory)

    def _remember(self, names: list[str], slots: range, memory: dict[str, int]) -> range:
        memory.update(zip(names, slots, strict=True))
        self.chars += sum(map(len, names))
        return slots

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """The slot of each piece; all are known then."""
        slots, new = self._look_up(_strings(pieces), self.known)
        if self.known and (len(self.known) + len(self.begun) + len(new) > self.cache or self.chars > self.cache_chars):
            self._forget()
            slots, new = np.empty(len(pieces), np.int64), np.arange(len(pieces))
        if len(new):
            slots[new] = self._learn(pieces.take(pa.array(new)))
        return slots

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of each text as uint32; null counts as empty."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts):
            return []
        whole, odd = np.zeros(len(texts), bool), pc.match_substring_regex(texts, _BLANKS).to_numpy(zero_copy_only=False)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        easy = ~(whole | odd)
        split = pc.split_pattern(texts.filter(pa.array(easy)), " ")
        lists = [[x] if w else _CUT.split(x) for x, w in zip(_strings(texts.filter(pa.array(~easy))), whole[~easy].tolist(), strict=True)]
        pieces = pa.concat_arrays([split.flatten(), pa.array([x for some in lists for x in some], texts.type)])
        sizes = np.concatenate([pc.list_value_length(split).to_numpy(), np.array([len(x) for x in lists], dtype=np.int64)])
        heads = np.cumsum(sizes) - sizes
        rest = np.ones(len(pieces), bool)
        rest[heads] = False

        distinct = pieces.filter(pa.array(rest)).dictionary_encode()
        names, of = distinct.dictionary, distinct.indices.to_numpy()
        long = pc.greater(pc.utf8_length(names), self.long)
        at = long.to_numpy(zero_copy_only=False)
        found = np.empty(len(names), np.int64)
        found[~at] = self._slots(names.filter(pc.invert(long)))
        kept = self.n_ids, self.n_slots
        found[at] = self._joined(_strings(names.filter(long)))
        slots = np.empty(len(pieces), np.int64)
        slots[rest] = found[of]
        slots[heads] = self._whole(_strings(pieces.take(pa.array(heads))))

        parts = [self._ids_of(slots[a : a + _SLOTS]) for a in range(0, len(slots), _SLOTS)]
        ends = np.cumsum(np.add.reduceat(np.concatenate([n for _, n in parts]), heads))
        self.n_ids, self.n_slots = kept
        if len(self.ids) > _SPARE + 4 * self.n_ids:
            self.ids = self.ids[: self.n_ids].copy()
        out: list[np.ndarray] = np.split(np.concatenate([x for x, _ in parts]), ends[:-1])
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        return [out[i] for i in np.argsort(order).tolist()]


@lru_cache(maxsize=1)
def _tables(path: str, changed: int) -> tuple:
    """What doesn't grow with the texts, so that a worker's later tasks need not read it again."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    # in a byte-level vocabulary a character stands for a byte
    for token, i in vocabulary.items():
        lengths[i] = len(token)
    alphabet = {i: tokenizer.pre_tokenizer.pre_tokenize_str(chr(i))[0][0] for i in range(128)}
    spare = iter(range(256, 512))
    # printable bytes stand for themselves, the others for what follows code point 255
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    as_bytes = [b if b in printable else next(spare) for b in range(256)]
    assert all(chr(as_bytes[i]) == alphabet[i] for i in range(128))
    # the model alone, without a pre-tokenizer, takes pre-tokens joined by a byte that is in no other token
    model = tokenizer.model
    merged = set().union(*(t for t in vocabulary if len(t) > 1))
    between = [b for b in _NO_BYTES if chr(as_bytes[b]) in vocabulary and chr(as_bytes[b]) not in merged]
    if model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix:
        between = []
    between_id = vocabulary[chr(as_bytes[between[0]])] if between else -1
    return tokenizer, Tokenizer(model), special, lengths, np.array(as_bytes, dtype="<u4"), bytes(between[:1]), between_id


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """`array`, or a longer one that begins with it, with room for `n`."""
    if n <= len(array):
        return array
    longer = np.empty(max(n, 2 * len(array)), array.dtype)
    longer[: len(array)] = array
    return longer


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))


def _chunks(items: list[str], n: int) -> Iterator[list[str]]:
    return (items[a : a + n] for a in range(0, len(items), n))
