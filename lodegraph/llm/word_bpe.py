"""Word-end BPE by speculation and verification.

Greedy longest match proposes each word's tokens. A sequence of tokens is what exact
merging gives if each token alone merges to itself and no adjacent pair could have
merged across its border earlier than inside; that test is made for all pairs of a batch at once in
numpy, by undoing the later of the two tokens' last merges until both are bytes.
Only words that fail are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer

#: What str.split() takes for blank but Unicode's White_Space does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Letters below this are letters in every version of Unicode's tables.
_PLAIN = "\u0250"
_FAR = 1 << 40
_BIG = np.int64(_FAR)


def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's letters: printable bytes stand for themselves, others for what follows code point 255."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class WordBPE:
    """Encodes and decodes as the tokenizers library does with a lower-casing, word-end BPE file.

    The file names NFC, white space to blanks and lower case as normalizers, a
    splitting pattern with \\p classes, and a BPE model with an end-of-word suffix over
    byte letters. Other files are refused. Results for a chunk of text between white
    space are remembered, `cache` chunks of `cache_chars` characters in all at most; chunks
    of over `long` characters, as in scripts without blanks, are not.
    """

    def __init__(self, path: str, cache: int = 800_000, cache_chars: int = 12_000_000, long: int = 256):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or bytes_["type"] != "ByteLevel" or not model["end_of_word_suffix"] or spec["decoder"]:
            raise ValueError("not a lower-casing word-end BPE file")
        whole = Tokenizer.from_file(path)
        self.normalize, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        self.letters = byte_alphabet()
        #: the longest token, less its end mark, by its first two letters
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            bare = token.removesuffix(self.end) or token
            self.reach[bare[:2]] = max(self.reach.get(bare[:2], 1), len(bare))
        self._merges([m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]])
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.cache, self.cache_chars, self.long, self.chars = cache, cache_chars, long, 0
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.numbers = [str(i) for i in range(max(self.names) + 1)]
        self.sound: dict[int, bool] = {}
        self.speculated = self.failed = 0

    def _merges(self, merges: list[list[str]]) -> None:
        n = max(self.vocab.values()) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        #: when a token is made; bytes are there from the start
        self.made = np.full(n, -1, np.int64)
        for k, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), (k, z))
            if self.made[z] < 0:
                self.made[z], self.left[z], self.right[z] = k, x, y
        keys = np.array([x << 32 | y for x, y in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([k for k, _ in self.rank.values()], dtype=np.int64)[order]

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _BIG)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens side by side, whether exact merging keeps them apart."""
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _BIG)
        while len(live):
            bad = self._rank_of(a, b) < limit
            out[live[bad]] = False
            later, sooner = self.made[a], self.made[b]
            go = ~bad & ((later >= 0) | (sooner >= 0))
            live, a, b, later, sooner = live[go], a[go], b[go], later[go], sooner[go]
            first = later > sooner
            # an equal merge at the border is further left than the right token's own, and goes first
            limit = np.where(first, later, sooner + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def greedy(self, word: str) -> list[int]:
        """Longest matches from the left over byte letters; the last token carries the end of the word."""
        vocab, at, n, out = self.vocab.get, 0, len(word), []
        while True:
            stop = at + self.reach.get(word[at : at + 2], 1)
            if stop >= n:
                stop = n - 1
                if (token := vocab(word[at:] + self.end)) is not None:
                    out.append(token)
                    return out
            while (token := vocab(word[at:stop])) is None:
                stop -= 1
                if stop <= at:
                    raise ValueError(f"no token for {word[at]!r}")
            out.append(token)
            at = stop

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        n = len(symbols)
        if n <= 32:
            rank, none, symbols = self.rank.get, (_FAR, 0), list(symbols)
            found = [rank(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
            while found:
                best = min(found)
                if best is none:
                    break
                i = found.index(best)
                symbols[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = rank((symbols[i - 1], best[1]), none)
                if i < len(found):
                    found[i] = rank((best[1], symbols[i + 1]), none)
            return symbols
        symbols = list(symbols)
        nexts, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(*self.rank[pair], i, pair) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in self.rank]
        heapq.heapify(heap)
        heap = [(k, i, z, pair) for k, z, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, (x, y) = heapq.heappop(heap)
            j = nexts[i]
            if gone[i] or j >= n or symbols[i] != x or symbols[j] != y:
                continue
            symbols[i], gone[j], nexts[i] = made, True, nexts[j]
            if nexts[i] < n:
                before[nexts[i]] = i
            for p, q in ((before[i], i), (i, nexts[i])):
                if p >= 0 and q < n and (found := self.rank.get((symbols[p], symbols[q]))):
                    heapq.heappush(heap, (found[0], p, found[1], (symbols[p], symbols[q])))
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def exact(self, word: str) -> list[int]:
        return self.merge([self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]])

    def _is_sound(self, token: int) -> bool:
        """Whether a token's own letters merge to it."""
        if token not in self.sound:
            name, end = self.names[token], self.end
            done = name.endswith(end) and len(name) > len(end)
            letters = name[: -len(end)] if done else name
            symbols = [self.vocab[c] for c in letters[:-1]] + [self.vocab[letters[-1] + end if done else letters[-1]]]
            self.sound[token] = self.merge(symbols) == [token]
        return self.sound[token]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of distinct words in byte letters."""
        proposed = [self.greedy(w) for w in words]
        lengths = np.array([len(p) for p in proposed])
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]
        failed = set(owner[inner[~fits]].tolist())
        unsound = [t for t in np.unique(flat).tolist() if not self._is_sound(t)]
        if unsound:
            failed |= set(owner[np.isin(flat, unsound)].tolist())
        self.speculated += len(words)
        self.failed += len(failed)
        for i in failed:
            proposed[i] = self.exact(words[i])
        return proposed

    def _split(self, segment: str) -> list[str]:
        return _WHITE.split(segment) if _SEPARATORS.search(segment) else segment.split()

    def _words(self, chunk: str) -> list[str]:
        """Words in byte letters of a chunk without white space."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,!?;:":
                return [chunk[:-1].lower(), chunk[-1]]
        elif max(chunk) >= _PLAIN:
            # which characters are letters, and their lower case, is up to the library's version of Unicode
            return [w for w, _ in self.split(self.normalize(chunk))]
        else:
            chunk = unicodedata.normalize("NFC", chunk)
        return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in self.pattern.findall(chunk.lower())]

    def _learn(self, chunks: list[str]) -> None:
        words_of = list(map(self._words, chunks))
        wanted = list({w: None for words in words_of for w in words if w not in self.words})
        if wanted:
            number, name = self.numbers.__getitem__, self.names.__getitem__
            for word, ids in zip(wanted, self.encode_words(wanted), strict=True):
                self.words[word] = (" ".join(map(number, ids)), " ".join(map(name, ids)))
        for chunk, words in zip(chunks, words_of, strict=True):
            if len(words) == 1:
                self.ids[chunk], self.text[chunk] = self.words[words[0]]
            else:
                pairs = [self.words[w] for w in words]
                self.ids[chunk], self.text[chunk] = " ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])

    def _chunks(self, text: str) -> list[str]:
        """Text between white space, and added tokens on their own."""
        if self.marks is None or not self.marks.search(text):
            return self._split(text)
        return [c for part in self.marks.split(text) for c in ([part] if part in self.special else self._split(part))]

    def encode_decode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each text (null: empty), its decimal ids and their decoded text, each joined by blanks."""
        cut = [[c for c in self._chunks(t or "") if c] for t in texts]
        wanted = list(dict.fromkeys(c for chunks in cut for c in chunks if c not in self.ids))
        if len(self.ids) + len(wanted) > self.cache or self.chars > self.cache_chars:
            self.ids, self.text, self.words, self.chars = {}, {}, {}, 0
            wanted = list(dict.fromkeys(c for chunks in cut for c in chunks))
        for mark in self.special.keys() & set(wanted):
            self.ids[mark], self.text[mark] = str(self.special[mark]), mark
        self._learn([c for c in wanted if c not in self.special])
        self.chars += sum(map(len, wanted))
        ids, text = self.ids.__getitem__, self.text.__getitem__
        out = [(" ".join(map(ids, c)), " ".join(map(text, c))) for c in cut]
        for chunk in wanted:
            if len(chunk) > self.long:
                del self.ids[chunk], self.text[chunk]
                self.words.pop(chunk, None)
        return out

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_decode([text])[0][0]
        return list(map(int, joined.split()))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode with skip_special_tokens=False: the tokens, joined by blanks. Unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)
