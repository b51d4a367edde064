"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers count tokens without building them. The first cuts text into pretokens: it has seven states
over ten character classes, and its transitions say where pretokens start. Texts are cut into chunks of equal length; a
chunk's state map says where each state leads, maps of all chunks are composed by a parallel prefix scan, and with the state
at each chunk's start known all chunks mark their starts at once. The second reads the bytes of one pretoken; its states are
sets of unfinished tokens with the token before each, its transitions carry the change of the token count, and both are
compiled when first met and kept. It runs once for each distinct pretoken of a batch.

The counts are those of the tokenizers library for byte-level BPE with word ends: NFC, lower case, white space dropped; a
special string inside a text is one token. Null and empty texts have none. Texts of any length are handled in segments.
Repeated rows get equal counts. An empty table gives an empty result. Other columns pass through; n_tokens is replaced.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges
from .common import small_batches
from .textscan import INVERSES, POWERS, U, mix64

# Character classes, and the states of the pretoken transducer.
SPACE, LETTER, DIGIT, OTHER, QUOTE, STMD, R, V, L, E = range(10)
FRESH, IN_LETTERS, IN_OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
# Code points of white space.
BLANK_CODES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 256
SEGMENT = 1 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = LETTER if kind == "L" else DIGIT
    table[BLANK_CODES] = SPACE
    for text, kind in (("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        table[[ord(x) for x in text]] = kind
    return table


def _pretoken_transducer() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and mark[state, class]: 1 if a pretoken starts at this character, 2 if at the one before it."""
    to, mark = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, STMD, R, V, L, E)
    for s in range(7):
        for c in range(10):
            late = 0
            state = s
            if s in (QUOTED_R, QUOTED_V, QUOTED_L):
                if c == {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}[s]:
                    continue  # 're, 've and 'll end here: FRESH, no mark
                state, late = IN_LETTERS, 2
            if c == SPACE:
                to[s, c], mark[s, c] = FRESH, late
            elif c in letters:
                if state == QUOTED and c in (STMD, R, V, L):
                    to[s, c] = {STMD: FRESH, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[c]
                else:
                    to[s, c], mark[s, c] = IN_LETTERS, late | (state != IN_LETTERS)
            elif c == DIGIT:
                to[s, c], mark[s, c] = FRESH, late | 1
            elif state in (IN_OTHERS, QUOTED):
                to[s, c] = IN_OTHERS
            else:
                to[s, c], mark[s, c] = QUOTED if c == QUOTE else IN_OTHERS, late | 1
    return to, mark


NEXT, MARK = _pretoken_transducer()


def pretoken_starts(kinds: np.ndarray) -> np.ndarray:
    """Where pretokens start in a sequence of classes that ends with SPACE."""
    n = len(kinds)
    rows = -(-n // CHUNK)
    padded = np.zeros(rows * CHUNK, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, CHUNK).T)
    flat_next, flat_mark = NEXT.ravel(), MARK.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8), (rows, 1))
    for kind in columns:
        maps = flat_next[maps * np.uint8(10) + kind[:, None]]
    step = 1
    while step < rows:  # maps[i] becomes the composition of chunks 0 to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate((np.zeros(1, np.uint8), maps[:-1, FRESH]))
    marks = np.empty((CHUNK, rows), np.uint8)
    for j, kind in enumerate(columns):
        at = state * np.uint8(10) + kind
        marks[j] = flat_mark[at]
        state = flat_next[at]
    marks = marks.T.ravel()[:n]
    here = (marks & 1).astype(bool)
    here[:-1] |= (marks[1:] & 2).astype(bool)
    return np.flatnonzero(here)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's strings, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTransducer:
    """Counts the tokens of one pretoken, given as bytes; the last byte carries the mark of a word's end."""

    def __init__(self, merges: list, end: str, max_states: int = 200_000):
        byte_of = byte_symbols()

        def token(text: str) -> tuple[bytes, bool]:
            final = text.endswith(end)
            return bytes(byte_of[c] for c in (text[: -len(end)] if final else text)), final

        ranks = {}
        tokens = {(bytes([b]), final) for b in range(256) for final in (False, True)}
        for i, pair in enumerate(merges):
            a, b = (token(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = (a[0] + b[0], b[1])
            ranks.setdefault((a, b), (i, whole))
            tokens.add(whole)
        self.merges = Merges(lambda a, b: ranks.get((a, b)))
        self.tokens = {t for t in tokens if self.merges.merge(self.symbols(t)) == [t]}
        # Trie of the tokens' bytes: child by (node, byte), and which nodes are tokens.
        self.child: dict[tuple[int, int], int] = {}
        self.inner: dict[int, tuple] = {}
        self.last: dict[int, tuple] = {}
        self.more: set[int] = set()
        nodes = 1
        for t in sorted(self.tokens):
            node = 0
            for i, b in enumerate(t[0]):
                if (node, b) not in self.child:
                    self.child[node, b] = nodes
                    nodes += 1
                self.more.add(node)
                node = self.child[node, b]
            (self.last if t[1] else self.inner)[node] = t
        self.max_states = max_states
        self._reset()

    def _reset(self) -> None:
        self.start = ((0, None, 0),)
        self.states = {self.start: 0}
        self.sets = [self.start]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]
        self.stops: list[dict[int, int]] = [{}]

    @staticmethod
    def symbols(token: tuple[bytes, bool]) -> list[tuple[bytes, bool]]:
        text, final = token
        return [(text[i : i + 1], final and i == len(text) - 1) for i in range(len(text))]

    def _follows(self, before, token) -> bool:
        return before is None or self.merges.apart(before, token, self.symbols)

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        live, new, found = self.sets[state], [], None
        for node, before, count in live:
            node = self.child.get((node, byte))
            if node is None:
                continue
            if found is None and (t := self.inner.get(node)) and self._follows(before, t):
                found = (t, count + 1)
            if node in self.more:
                new.append((node, before, count))
        token, change = found
        key = (*((node, before, count - change) for node, before, count in new), (0, token, 0))
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.stops.append({})
        self.steps[state][byte] = (to, change)
        return to, change

    def _stop(self, state: int, byte: int) -> int:
        for node, before, count in self.sets[state]:
            node = self.child.get((node, byte))
            if node is not None and (t := self.last.get(node)) and self._follows(before, t):
                self.stops[state][byte] = count + 1
                return count + 1
        raise AssertionError("every byte is a token")

    def count(self, word: bytes) -> int:
        if len(self.sets) > self.max_states:
            self._reset()
        state = total = 0
        steps = self.steps
        for byte in word[:-1]:
            state, change = steps[state].get(byte) or self._compile(state, byte)
            total += change
        return total + (self.stops[state].get(word[-1]) or self._stop(state, word[-1]))


class Counter:
    """Counts the tokens of whole texts under a tokenizer's JSON file."""

    def __init__(self, spec: dict, max_words: int = 1 << 18):
        self.words = WordTransducer(spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.known: dict[int, int] = {}
        self.max_words = max_words

    @staticmethod
    def _plain(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()

    def prepared(self, text: str) -> tuple[str, int]:
        """(normalised text, number of special strings in it)."""
        if self.special is None or "<" not in text or not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return " ".join(map(self._plain, parts)), len(parts) - 1

    def segment(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, token counts) of the pretokens of a text that ends with a blank."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = classes()[codes]
        starts = pretoken_starts(kinds)
        if not len(starts):
            return starts, starts
        blanks = np.flatnonzero(kinds == SPACE)
        ends = np.minimum(np.append(starts[1:], len(codes)), blanks[np.searchsorted(blanks, starts)])
        if len(codes) < len(POWERS):
            with np.errstate(over="ignore"):
                sums = np.empty(len(codes) + 1, U)
                sums[0] = 0
                np.cumsum((codes.astype(U) + U(0x51ED270B)) * POWERS[: len(codes)], out=sums[1:])
                h = mix64((sums[ends] - sums[starts]) * INVERSES[starts] ^ (ends - starts).astype(U))
            h, first, back = np.unique(h, return_index=True, return_inverse=True)
        else:  # one pretoken longer than a segment
            h, first, back = np.arange(len(starts)), np.arange(len(starts)), np.arange(len(starts))
            self.known.clear()
        if len(self.known) > self.max_words:
            self.known.clear()
        counts = np.empty(len(h), np.int64)
        known = self.known
        for i, (key, s, e) in enumerate(zip(h.tolist(), starts[first].tolist(), ends[first].tolist(), strict=True)):
            n = known.get(key)
            if n is None:
                n = known[key] = self.words.count(text[s:e].encode("utf-8", "surrogatepass"))
            counts[i] = n
        if len(codes) >= len(POWERS):
            known.clear()
        return starts, counts[back]

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held, sizes, rows = [], [], []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                starts, n = self.segment("".join(held))
                np.add.at(out, np.array(rows)[np.searchsorted(np.cumsum(sizes), starts, "right")], n)
            held.clear(), sizes.clear(), rows.clear()
            size = 0

        for i, text in enumerate(texts):
            text, special = self.prepared(text)
            out[i] += special
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > SEGMENT // 2:
                    cut = max(text.rfind(" ", at, at + SEGMENT // 2), text.rfind("\n", at, at + SEGMENT // 2))
                    if cut <= at:
                        cut = min((x for x in (text.find(" ", at + 1), text.find("\n", at + 1)) if x > 0), default=end)
                    end = cut
                part = text[at:end] + " "
                if size and size + len(part) > SEGMENT - 2:
                    flush()
                held.append(part), sizes.append(len(part)), rows.append(i)
                size += len(part)
                at = max(end, at + 1)
        flush()
        return out


def counter_of(spec_json: str) -> Counter:
    """One counter for each Python worker and tokenizer."""
    return _counters(spec_json)


@functools.lru_cache(maxsize=2)
def _counters(spec_json: str) -> Counter:
    return Counter(json.loads(spec_json))


def with_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs with n_tokens (long). tokenizer: a path to the tokenizer's JSON on the driver; its contents go to the executors."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        return pa.array(counter_of(spec.value).counts([t.as_py() or "" for t in texts]), pa.int64())

    return small_batches(docs).withColumn("n_tokens", counted("text"))
