"""A word-end BPE tokenizer compiled to finite-state transducers that emit token counts.

Two deterministic machines stand for the tokenizer:

1. `WordMachine` cuts text into words. Its transitions tell whether a word starts at the
   character read, or at the one before (an apostrophe and a letter turn out to be no
   contraction). It has seven states, so the map from entry to exit state of any stretch
   is one of a few functions, the machine's transition monoid. A batch is cut into chunks of equal length
   that run side by side in numpy; each chunk's map is one number, and a parallel prefix
   scan composes them into every chunk's entry state.
2. `BpeMachine` reads a word's bytes. Exact merging gives each prefix of a word one last token,
   and a token may follow another only if merging keeps them apart. A state is the set of
   tokens under way: the token before, the place in the token trie, and how many tokens
   less than the prefix has stand before it. Reading a byte moves each of them, and the one that
   becomes a whole token is the new last one; the transition emits by how much the count changes.
   States are made when first met (there are too many to make all), and forgotten beyond a bound.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.slices import sliced
from lodegraph.llm.word_bpe import WordBPE, byte_alphabet

_BLANK = re.compile(r"(\s+)")
#: Characters below this have the same letters and lower case in every version of Unicode's tables.
_PLAIN = 0x250
_HIGH = re.compile("[ɐ-\U0010ffff]")
#: Stands for an added token between texts' characters.
_MARK = 0x110000
_ASCII = re.compile("[\x00-\x7f]")
_BLANKS = np.array([32], np.uint32)
_ADDED = np.array([_MARK], np.uint32)
_PART = ord("A")

BETWEEN, LETTERS, SYMBOLS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
SPACE, LETTER, ENDS, R, V, L, E, NUMBER, SYMBOL, APOSTROPHE, ADDED = range(11)
STARTS, BEFORE = 1, 2


def word_transition(state: int, kind: int) -> tuple[int, int]:
    """(next state, what starts): the words `'s 't 'm 'd 're 've 'll`, runs of letters, single numbers, runs of other characters."""
    letter = LETTER <= kind <= E
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (L if state == QUOTE_L else E):
            return BETWEEN, 0
        to, starts = word_transition(LETTERS, kind)
        return to, starts | BEFORE
    if state == QUOTE:
        if kind == ENDS:
            return BETWEEN, 0
        if kind in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
        state = SYMBOLS
    if letter:
        return LETTERS, 0 if state == LETTERS else STARTS
    if kind in (SYMBOL, APOSTROPHE):
        if state == SYMBOLS:
            return SYMBOLS, 0
        return SYMBOLS if kind == SYMBOL else QUOTE, STARTS
    return BETWEEN, 0 if kind == SPACE else STARTS


class WordMachine:
    """Where words start, for characters given by kind, a whole batch at a time."""

    def __init__(self, chunk: int = 512):
        kinds, states = range(11), range(7)
        self.chunk = chunk
        table = [[word_transition(s, k) for k in kinds] for s in states]
        self.next, self.starts = np.zeros(7 * 16, np.uint8), np.zeros(7 * 16, np.uint8)
        for s in states:
            for k in kinds:
                self.next[s * 16 + k], self.starts[s * 16 + k] = table[s][k]
        # the transition monoid: all maps of states that stretches of characters make
        maps, at = [tuple(states)], 0
        known = {maps[0]: 0}
        while at < len(maps):
            for k in kinds:
                after = tuple(table[s][k][0] for s in maps[at])
                if after not in known:
                    known[after] = len(maps)
                    maps.append(after)
            at += 1
        n = len(maps)
        self.step = np.zeros(n * 16, np.uint16)
        for i, m in enumerate(maps):
            for k in kinds:
                self.step[i * 16 + k] = known[tuple(table[s][k][0] for s in m)]
        self.compose = np.array([[known[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
        self.of_start = np.array([m[BETWEEN] for m in maps], np.uint8)

    def entries(self, kinds: np.ndarray) -> np.ndarray:
        """The state in which each chunk (row) of `kinds` is entered."""
        maps = np.zeros(len(kinds), np.uint16)
        for column in kinds.T:
            maps = self.step[maps * np.uint16(16) + column]
        far = 1
        while far < len(maps):
            # each map takes in those of `far` chunks before it
            maps[far:] = self.compose[maps[:-far], maps[far:]]
            far *= 2
        return np.r_[np.uint8(BETWEEN), self.of_start[maps[:-1]]].astype(np.uint8)

    def word_starts(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a word starts at each character. The last one has to be a blank."""
        n = len(kinds)
        rows = -(-n // self.chunk)
        dealt = np.zeros((rows, self.chunk), np.uint8)
        dealt.reshape(-1)[:n] = kinds
        state, out = self.entries(dealt), np.empty((self.chunk, rows), np.uint8)
        for i, column in enumerate(np.ascontiguousarray(dealt.T)):
            at = state * np.uint8(16) + column
            out[i] = self.starts[at]
            state = self.next[at]
        told = out.T.reshape(-1)[:n]
        starts = (told & STARTS).astype(bool)
        starts[:-1] |= (told[1:] & BEFORE).astype(bool)
        return starts


class BpeMachine:
    """Token counts of words, by a transducer over bytes whose states are made when they are met."""

    def __init__(self, bpe: WordBPE, states: int = 250_000):
        self.bpe, self.most = bpe, states
        self.made, self.left, self.right = bpe.made.tolist(), bpe.left.tolist(), bpe.right.tolist()
        byte_of = {c: b for b, c in byte_alphabet().items()}
        #: the trie of tokens: bytes to nodes, and the token that ends at a node, or with a word's last byte after it
        self.below: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.last: list[dict[int, int]] = [{}]
        for name, token in bpe.vocab.items():
            ends = name.endswith(bpe.end) and len(name) > len(bpe.end)
            letters = [byte_of[c] for c in (name[: -len(bpe.end)] if ends else name)]
            if not bpe._is_sound(token):
                continue
            node = 0
            for b in letters[:-1] if ends else letters:
                if b not in self.below[node]:
                    self.below[node][b] = len(self.below)
                    self.below.append({})
                    self.token.append(-1)
                    self.last.append({})
                node = self.below[node][b]
            if ends:
                self.last[node][letters[-1]] = token
            else:
                self.token[node] = token
        self.apart: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        first = ((-1, 0, 0),)
        self.states, self.parts = {first: 0}, [first]
        #: by state * 256 + byte: next state * 256 + change of the count + 128; and the change at the end of a word
        self.moves: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        if len(self.apart) > 4 * self.most:
            self.apart = {}

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging keeps token a apart from token b after it; see `WordBPE.compatible`."""
        if a < 0:
            return True
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            rank, made, limit, known = self.bpe.rank, self.made, 1 << 40, True
            while True:
                found = rank.get((a, b))
                if found is not None and found[0] < limit:
                    known = False
                    break
                later, sooner = made[a], made[b]
                if later < 0 and sooner < 0:
                    break
                if later > sooner:
                    limit, a = later, self.right[a]
                else:
                    limit, b = sooner + 1, self.left[b]
            self.apart[key] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        under_way, token, count = [], -1, 0
        for before, node, less in self.parts[state]:
            to = self.below[node].get(byte)
            if to is None:
                continue
            if token < 0 and self.token[to] >= 0 and self._fits(before, self.token[to]):
                token, count = self.token[to], less + 1
            if self.below[to] or self.last[to]:
                under_way.append((before, to, less))
        if token < 0:
            raise ValueError(f"no token ends with byte {byte}")
        parts = (*[(before, node, less - count) for before, node, less in under_way], (token, 0, 0))
        to = self.states.setdefault(parts, len(self.parts))
        if to == len(self.parts):
            self.parts.append(parts)
        self.moves[state << 8 | byte] = move = to << 8 | count + 128
        return move

    def _end(self, state: int, byte: int) -> int:
        for before, node, less in self.parts[state]:
            token = self.last[node].get(byte)
            if token is not None and self._fits(before, token):
                self.ends[state << 8 | byte] = less + 1
                return less + 1
        raise ValueError(f"no token ends a word with byte {byte}")

    def count(self, word: bytes) -> int:
        """Tokens of one word, which has a byte at least."""
        if len(self.parts) > self.most:
            self._forget()
        moves, state, n = self.moves.get, 0, 0
        for byte in word[:-1]:
            move = moves(state << 8 | byte) or self._move(state, byte)
            state = move >> 8
            n += (move & 255) - 128
        end = self.ends.get(state << 8 | word[-1])
        return n + (self._end(state, word[-1]) if end is None else end)


class TokenCounter:
    """Counts tokens of texts as the tokenizers library does with a lower-casing, word-end BPE file (see `WordBPE`).

    Counts of words are remembered, `cache` words of up to `long` bytes at most. Texts are taken up in
    pieces of about `piece` characters, cut before an ASCII character, so memory
    does not grow with a text that has any. A piece's open word goes on in the next piece.
    """

    def __init__(self, path: str, cache: int = 600_000, long: int = 64, piece: int = 1 << 21, states: int = 250_000):
        self.bpe = WordBPE(path)
        self.words, self.machine = WordMachine(), BpeMachine(self.bpe, states)
        self.cache, self.long, self.piece = cache, long, piece
        self.counts: dict[str, int] = {}
        self.kinds = np.full(_MARK + 1, 255, np.uint8)
        self.kinds[[ord(c) for c in "stmd"]] = ENDS
        self.kinds[[ord(c) for c in "rvle'"]] = (R, V, L, E, APOSTROPHE)
        self.kinds[_MARK] = ADDED

    def _normal(self, part: str) -> str:
        """As the file's normalizer does; white space stays as it is, since all of it parts words."""
        if part.isascii():
            return part.lower()
        if not _HIGH.search(part):
            return unicodedata.normalize("NFC", part).lower()
        return "".join(c if c.isspace() else self.bpe.normalize(c) if _HIGH.search(c) else unicodedata.normalize("NFC", c).lower() for c in _BLANK.split(part) if c)

    def _kind(self, code: int) -> int:
        """The kind of a character, by how the library's own pattern cuts it."""
        c = chr(code)
        if not self.bpe.split(c):
            return SPACE
        if len(self.bpe.split("a" + c)) == 1:
            return LETTER
        return NUMBER if len(self.bpe.split(c + c)) == 2 else SYMBOL

    def _kinds(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kinds[codes]
        if (new := kinds == 255).any():
            for code in np.unique(codes[new]).tolist():
                self.kinds[code] = self._kind(code)
            kinds = self.kinds[codes]
        return kinds

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that can be normalized one by one, and added tokens on their own."""
        for part in self.bpe.marks.split(text) if self.bpe.marks else [text]:
            at, n = 0, len(part)
            while n - at > self.piece and part not in self.bpe.special:
                cut = _ASCII.search(part, at + self.piece)
                if cut is None:
                    break
                yield part[at : cut.start()]
                at = cut.start()
            if at < n:
                yield part[at:]

    def _count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word."""
        known = self.counts
        got = list(map(known.get, words))
        if None in got:
            if len(known) > self.cache:
                known.clear()
                got = [None] * len(words)
            for i, n in enumerate(got):
                if n is None:
                    word = words[i]
                    if (n := known.get(word)) is None:
                        raw = word.encode("utf-8", "surrogatepass")
                        n = self.machine.count(raw)
                        if len(raw) <= self.long:
                            known[word] = n
                    got[i] = n
        return np.array(got, np.int64)

    def _stream(self, parts: list[tuple[int, str | None]], counts: np.ndarray, goes_on: bool = False) -> list[tuple[int, str | None]]:
        """Adds the tokens of parts (owner, normalized text or None for an added token) to the owners' counts.

        With `goes_on`, the last owner's text does, and its last two words are handed back: the last may be
        longer than it seems, or part of the one before.
        """
        codes, owners, bounds = [], [], [0]
        for owner, part in parts:
            own = _ADDED if part is None else np.frombuffer(part.encode("utf-32-le"), np.uint32)
            if owners and owners[-1] != owner:
                codes.append(_BLANKS)
                bounds[-1] += 1
            codes.append(own)
            owners.append(owner)
            bounds.append(bounds[-1] + len(own))
        flat, of = np.concatenate([*codes, _BLANKS]), np.array(owners)
        kinds = self._kinds(flat)
        starts = self.words.word_starts(kinds)
        added = np.flatnonzero(kinds == ADDED)
        np.add.at(counts, of[np.searchsorted(bounds, added, side="right") - 1], 1)
        starts[added] = False
        at, held = np.flatnonzero(starts), []
        if goes_on:
            own = max(bounds[owners.index(owners[-1])], int(added[-1]) + 1 if len(added) else 0)
            if len(last := at[at >= own]):
                cut = int(last[-2:][0])
                held = [(owners[-1], flat[cut:-1].tobytes().decode("utf-32-le"))]
                flat, kinds, starts, at = flat[:cut], kinds[:cut], starts[:cut], at[at < cut]
        if len(at):
            # a capital letter, of which normalized text has none, before each word and for each blank
            spread = np.full(len(flat) + len(at), _PART, np.uint32)
            spread[np.arange(len(flat)) + np.cumsum(starts)] = np.where((kinds == SPACE) | (kinds == ADDED), _PART, flat)
            words = [w for w in spread.tobytes().decode("utf-32-le").split(chr(_PART)) if w]
            np.add.at(counts, of[np.searchsorted(bounds, at, side="right") - 1], self._count(words))
        return held

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text (null: none)."""
        counts = np.zeros(len(texts), np.int64)
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in self._pieces(text or ""):
                held.append((i, None if part in self.bpe.special else self._normal(part)))
                size += len(part)
                if size >= self.piece:
                    held = self._stream(held, counts, goes_on=True)
                    size = sum(len(part) for _, part in held)
        if held:
            self._stream(held, counts)
        return counts


@lru_cache(maxsize=1)
def _counter(path: str) -> TokenCounter:
    """A worker's own counter, which later tasks use again."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, batch_bytes: int = 1 << 23) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of `docs` (doc_id, text; other columns don't matter).

    n_bytes counts UTF-8, n_tokens what the tokenizers library makes of the text without added special
    tokens; over_limit says that it is more than `limit`. A null text counts as empty: 0, 0, false. A null
    doc_id stays null, rows that repeat have a result each, an empty table gives no rows. Nothing is
    shuffled; texts are taken up in pieces, so a task's memory doesn't grow with theirs.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            for part in sliced(batch, 1, batch_bytes):
                sizes = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                tokens = counter.count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
