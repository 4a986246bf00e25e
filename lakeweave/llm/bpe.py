"""Byte-pair encoding over distinct pre-tokens, and text encoders that remember what each word becomes.

A pre-token never holds the white space that ends it, so a text's ids are the ids of its white-space separated
words one after the other. Encoders below therefore encode each distinct word once per worker and look the rest up;
what they return equals the library's result for the whole text (the tests compare them).
"""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Words that one worker remembers at most, and letters of those over 32 that it remembers at most.
REMEMBERED, LONG_LETTERS = 1_000_000, 2_000_000
NONE = np.iinfo(np.int64).max


class Merges:
    """The merge table of a tokenizers BPE file as sorted arrays: pair -> rank and resulting id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.size = max(self.vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is no such merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start symbols of byte-level pre-tokens, flat, and each one's count."""
        get = self.vocab.__getitem__
        flat = [get(c) for w in words for c in (*w[:-1], w[-1] + self.suffix)]
        return np.array(flat, dtype=np.int64), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def leftmost(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of ascending pair positions, those that merge when equal pairs overlap: every other one of each run."""
    if len(at) < 2:
        return at
    chained = nxt[at[:-1]] == at[1:]
    if not chained.any():
        return at
    start = np.r_[True, ~chained]
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[since % 2 == 0]


def merge_by_rank_rounds(merges: Merges, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rank-synchronous merging: every round applies, in all sequences at once, each one's lowest-rank pair.

    Returns the surviving symbols, flat, and how many each word has. Words of over ``LONG`` symbols take many rounds, so
    these look at changed places only.
    """
    sym, counts = merges.symbols(words)
    seq = np.repeat(np.arange(len(words)), counts)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    long = np.flatnonzero(counts > LONG)
    if len(long):
        own = np.repeat(counts > LONG, counts)
        left, kept = _long_rounds(merges, sym[own], counts[long])
        done.append((np.repeat(long, kept), left))
        sym, seq = sym[~own], seq[~own]
    while len(sym):
        rank = np.full(len(sym), NONE)
        same = seq[1:] == seq[:-1]
        rank[:-1][same] = merges.rank(sym[:-1][same], sym[1:][same])
        starts = np.flatnonzero(np.r_[True, ~same])
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(sym)])
        over = np.repeat(least == NONE, sizes)
        if over.any():
            done.append((seq[over], sym[over]))
            least, sizes = least[least != NONE], sizes[least != NONE]
            sym, seq, rank = sym[~over], seq[~over], rank[~over]
            if not len(sym):
                break
        hit = leftmost(np.flatnonzero(rank == np.repeat(least, sizes)), np.arange(1, len(sym) + 1))
        sym = sym.copy()
        sym[hit] = merges.made[rank[hit]]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        sym, seq = sym[keep], seq[keep]
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
    seqs, syms = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
    order = np.argsort(seqs, kind="stable")
    return syms[order], np.bincount(seqs, minlength=len(words))


#: Symbols from which a sequence's ranks are kept in blocks, and symbols of a block.
LONG, RANKS = 64, 32


def _long_rounds(merges: Merges, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rounds, with each block's least rank at hand: a round reads these, the blocks that hold its pairs, and what it changes."""
    blocks = -(-counts // RANKS)
    base = (np.cumsum(blocks) - blocks) * RANKS
    n = int(blocks.sum()) * RANKS
    place = ragged(base, counts)
    sym = np.zeros(n, dtype=np.int64)
    sym[place] = symbols
    alive = np.zeros(n, dtype=bool)
    alive[place] = True
    nxt, prv = np.full(n, -1), np.full(n, -1)
    inner = np.ones(len(place), dtype=bool)
    inner[np.cumsum(counts) - 1] = False
    nxt[place[inner]] = place[inner] + 1
    prv[place[inner] + 1] = place[inner]
    rank = np.full(n, NONE)

    def ranked(at: np.ndarray) -> None:
        on = nxt[at] >= 0
        rank[at[~on]] = NONE
        rank[at[on]] = merges.rank(sym[at[on]], sym[nxt[at[on]]])

    ranked(place)
    table, first = rank.reshape(-1, RANKS), np.cumsum(blocks) - blocks
    least = table.min(axis=1)
    while True:
        want = np.repeat(np.minimum.reduceat(least, first), blocks)
        where = np.flatnonzero((least == want) & (want != NONE))
        if not len(where):
            break
        row, column = np.nonzero(table[where] == want[where, None])
        at = leftmost(where[row] * RANKS + column, nxt)
        gone = nxt[at]
        sym[at] = merges.made[rank[at]]
        alive[gone] = False
        rank[gone] = NONE
        after = nxt[gone]
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        changed = np.concatenate([at, before[before >= 0]])
        ranked(changed)
        touched = np.unique(np.concatenate([changed, gone]) // RANKS)
        least[touched] = table[touched].min(axis=1)
    return sym[alive], np.add.reduceat(alive.reshape(-1, RANKS).sum(axis=1), first)


def merge_by_pair_index(merges: Merges, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pair occurrence index: the positions of every mergeable pair, worked off by ascending rank.

    A merge changes its neighbours' pairs; these positions go to the lists of their new ranks, and entries that no
    longer hold their pair are skipped when their rank comes up.
    """
    sym, counts = merges.symbols(words)
    n = len(sym)
    ends = np.cumsum(counts)
    last = np.zeros(n, dtype=bool)
    last[ends[counts > 0] - 1] = True
    first = np.r_[True, last[:-1]] if n else last
    nxt = np.where(last, -1, np.arange(1, n + 1))
    prv = np.where(first, -1, np.arange(-1, n - 1))
    alive = np.ones(n, dtype=bool)
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = merges.rank(sym[at], sym[nxt[at]])
        at, rank = at[rank != NONE], rank[rank != NONE]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    enter(np.flatnonzero(~last))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        at = at[alive[at] & (nxt[at] >= 0)]
        at = at[merges.rank(sym[at], sym[nxt[at]]) == r]
        at = leftmost(at, nxt)
        if not len(at):
            continue
        gone = nxt[at]
        sym[at] = merges.made[r]
        alive[gone] = False
        after = nxt[gone]
        nxt[at] = after
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        enter(np.unique(np.concatenate([before[before >= 0], at[after >= 0]])))
    return sym[alive], np.bincount(np.repeat(np.arange(len(words)), counts)[alive], minlength=len(words))


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def words_of(text: str) -> list[str]:
    """A text's pieces between white space that every library's pattern also takes as white space."""
    return text.split(" ") if any(map(text.__contains__, CONTROL)) else text.split()


#: White space to str.split() but not to the vocabularies' patterns.
CONTROL = "\x1c\x1d\x1e\x1f"


def pretokens(tokenizer: Tokenizer, words: list[str]) -> tuple[list[list], list[str]]:
    """For each word its parts: indices into the distinct byte-level pre-tokens, or ("special", id)."""
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    pattern = re.compile("(" + "|".join(map(re.escape, special)) + ")")
    seen: dict[str, int] = {}
    parts = []
    for word in words:
        own: list = []
        simple = simple_parts(word)
        if simple is not None:
            parts.append([seen.setdefault(p, len(seen)) for p in simple])
            continue
        for piece in pattern.split(word) if "<|" in word else (word,):
            if piece in special:
                own.append(("special", special[piece]))
            elif piece:
                piece = tokenizer.normalizer.normalize_str(piece)
                own.extend(seen.setdefault(p, len(seen)) for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(piece))
        parts.append(own)
    return parts, list(seen)


def encode_words(path: str, words: list[str], merge) -> list[np.ndarray]:
    """ids of each word by the given merging function."""
    parts, distinct = pretokens(library(path), words)
    flat, counts = merge(merges(path), distinct)
    ends = np.cumsum(counts)
    ids = [flat[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
    return [np.concatenate([np.array([p[1]]) if isinstance(p, tuple) else ids[p] for p in own]) if own else np.zeros(0, dtype=np.int64) for own in parts]


class Remembered:
    """word -> value for each list's words; the values of words not seen yet are made all at once.

    When half of ``limit`` words have come, or long ones of LONG_LETTERS letters, they become the older half; words not
    looked up until the next such change are forgotten, which costs time and changes no result. So memory has a bound
    in bytes for texts without spaces too.
    """

    def __init__(self, make, limit: int = REMEMBERED):
        self.make, self.limit = make, limit
        self.known: dict = {}
        self.older: dict = {}
        self.letters = 0

    def __iter__(self):
        return iter(self.known)

    def learn(self, lists: list[list[str]]) -> dict:
        """What all words of these lists become, among others."""
        if 2 * len(self.known) > self.limit or self.letters > LONG_LETTERS:
            self.older, self.known, self.letters = self.known, {}, 0
        known, older = self.known, self.older
        fresh = set().union(*lists).difference(known)
        if fresh:
            self.letters += sum([n for n in map(len, fresh) if n > 32])
            if older:
                again = [w for w in fresh if w in older]
                known.update(zip(again, map(older.__getitem__, again), strict=True))
                fresh.difference_update(again)
            made = list(fresh)
            if made:
                known.update(zip(made, self.make(made), strict=True))
        return known

    def look(self, lists: list[list[str]]) -> list[list]:
        """The values of each list's words."""
        get = self.learn(lists).__getitem__
        return [list(map(get, words)) for words in lists]


def packed(encoding) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return np.array(encoding.ids, dtype="<u4").tobytes()


class SpacedEncoder:
    """ids of whole texts, as little-endian 32-bit integers, for a byte-level file whose words keep the space before them.

    A word is what stands between two single spaces; the pattern that splits pre-tokens takes at most one space
    before a word, so each word with its space can be encoded alone, unless it is empty or touches other white
    space at its ends. Words not seen yet are encoded many at a time: the spaces tell where each one's ids start. Texts
    with words that cannot be encoded alone go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.words = same_by_ranks(path)
        vocab = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.starts[[i for t, i in vocab.items() if t.startswith(_LETTERS[ord(" ")])]] = True
        self.first = Remembered(self._alone, 50_000)
        self.rest = Remembered(self._spaced, 500_000)  # a miss costs less here

    def _alone(self, words: list[str]) -> list[bytes]:
        encode = self.words.encode_ordinary
        return [ODD if _odd(w) else np.array(encode(w), dtype="<u4").tobytes() for w in words]

    def _spaced(self, words: list[str]) -> list[bytes]:
        odd = [_odd(w) for w in words]
        text = " ".join(["", *compress(words, map(not_, odd))])
        ids = np.array(self.words.encode_ordinary(text), dtype="<u4")
        at = (4 * np.flatnonzero(self.starts[ids])).tolist()
        raw = ids.tobytes()
        own = iter([raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)] if at else [])
        return [ODD if o else next(own) for o in odd]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        firsts = self.first.look([[s.pop(0)] for s in split])
        get = self.rest.learn(split).__getitem__
        out = []
        for text, (first,), words in zip(texts, firsts, split, strict=True):
            try:
                if first is ODD and text[:1] not in ("", " "):
                    raise TypeError
                out.append((first or b"") + b"".join(map(get, words)))
            except TypeError:  # ODD is among them
                out.append(packed(self.tokenizer.encode(text, add_special_tokens=False)))
        return out


#: What a word has that cannot be encoded alone.
ODD = False


def _odd(word: str) -> bool:
    return not word or word.strip() != word or "<|" in word


def byte_letters() -> dict[int, str]:
    """The letter that byte-level files write for each byte: itself if it can be printed, or else from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Stands for the end of a word in the faster library's pieces; words that hold it themselves do not go there.
END = "\0"


@lru_cache(maxsize=4)
def same_by_ranks(path: str) -> tiktoken.Encoding:
    """The vocabulary of a byte-level file whose ids follow its merges' ranks, for the faster library.

    Texts without special strings get the same ids, if each symbol's own letters merge to it (the tests look at all). A
    file with an end-of-word mark takes words that are ready, each with END behind it.
    """
    own = merges(path)
    if (np.diff(own.made) <= 0).any():
        raise ValueError(f"ids do not follow ranks in {path}")
    back = {c: bytes([b]) for b, c in byte_letters().items()}
    special = {t.content for t in library(path).get_added_tokens_decoder().values()}
    ranks = {}
    for token, i in own.vocab.items():
        if token not in special:
            ends = bool(own.suffix) and token.endswith(own.suffix)
            ranks[b"".join(map(back.__getitem__, token[: len(token) - len(own.suffix)] if ends else token)) + (END.encode() if ends else b"")] = i
    return tiktoken.Encoding(path, pat_str=f"[^{END}]+{END}" if own.suffix else public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Words whose parts are known without the library's pattern: letters that normalisation only lowers, then marks (no apostrophe, which can begin a part).
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
_LETTERS = byte_letters()


def simple_parts(word: str) -> list[str] | None:
    """Byte-level pre-tokens of a simple word; None for others."""
    if word.isascii() and word.isalpha():
        return [word.lower()]
    m = SIMPLE.fullmatch(word)
    if not m:
        return None
    letters, marks = m.groups()
    if not letters:
        return [marks] if marks else []
    low = letters.lower() if letters.isascii() else letters.lower().encode().decode("latin-1").translate(_LETTERS)
    return [low, marks] if marks else [low]


def ready(word: str) -> str | None:
    """A simple word's pre-tokens as text with END between them; None for other words."""
    if word.isascii() and word.isalpha():
        return word.lower()
    m = SIMPLE.fullmatch(word)
    return None if m is None else END.join([x for x in (m[1].lower(), m[2]) if x])


class WordEncoder:
    """ids of whole texts, as little-endian 32-bit integers, for a file that drops white space, from each distinct word.

    Simple words are encoded many at a time by the faster library: the end-of-word mark tells where each one's ids
    stop. Others go to the tokenizers library.
    """

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.ready = same_by_ranks(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memory = Remembered(self._encode, 1_400_000)

    def _encode(self, words: list[str]) -> list[bytes]:
        parts = [ready(w) for w in words]
        simple = [p for p in parts if p]
        ids = np.array(self.ready.encode_ordinary(END.join(simple) + END if simple else ""), dtype="<u4")
        last = np.flatnonzero(self.ends[ids])  # where pre-tokens stop
        stops = (4 * (last[np.cumsum([p.count(END) + 1 for p in simple]) - 1] + 1)).tolist() if simple else []
        raw = ids.tobytes()
        own = iter([raw[a:b] for a, b in zip([0, *stops], stops, strict=False)])
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, parts, strict=True) if p is None], add_special_tokens=False))
        return [next(own) if p else b"" if p == "" else packed(next(rest)) for p in parts]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [words_of(t) for t in texts]
        get = self.memory.learn(split).__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=4)
def spaced_encoder(path: str) -> SpacedEncoder:
    """One per worker process."""
    return SpacedEncoder(path)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


def forget() -> None:
    """Drops the encoders with what they remember, and the files' tables."""
    for kept in (spaced_encoder, word_encoder, same_by_ranks, merges, library):
        kept.cache_clear()


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
