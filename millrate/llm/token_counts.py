"""Token counts by finite-state tokenizer compilation (operator 9).

The tokenizer is compiled to a deterministic transducer that reads the bytes of
normalised text, the last byte of each word marked, and gives the number of
emitted tokens on its transitions.

* Byte pairs: the tokens of a word are the only sequence in which every two
  neighbours stay as they are when merged alone.  So the tokenization of each
  prefix ends in exactly one token that fits its left neighbour, and a state
  needs, for each start that a longer token may still cover, the place in the
  vocabulary's trie, the token before it and the count there.  Counts are kept
  relative to the present one, which makes the states finite; a transition
  carries the change of the count, negative where an open split is undone.
* States and transitions are compiled when first met and kept, in bounded
  tables that start anew when full.
* Words: classes of characters and contractions mark each word's last byte.

Bytes are cut into chunks of :data:`CHUNK`.  A word's end leads to the start
state from any state, so a chunk's map from entry state to exit state and count
is: its head (up to the first word end) from the entry state, and constant after
that.  Pass one runs all chunks side by side from their first word end; a prefix
scan composes the maps, running the heads of chunks without any word end one
after the other; pass two runs the heads from the states so found.

Special strings count one token each and split the text, as the library does.

Defined results: a NULL or empty text has no bytes and no tokens; NULL and
repeated ids pass as they are; an empty table gives no rows; other columns take
no part.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrate.llm import word_bpe
from millrate.llm.common import pieces

LIMIT = 2048
CHUNK = 256
#: Symbols that run side by side; cut at word ends.
SLAB = 1 << 20
#: States of a worker's transducer; a full one starts anew.
STATES = 250_000
#: A table's entry is the target state and the change of the count plus this.
_CHANGE = 128
_LETTER, _DIGIT, _OTHER, _SPACE = 0, 1, 2, 3


class Vocabulary:
    """Tokens as byte strings with or without a word end, and which neighbours
    stay as they are."""

    def __init__(self, spec: dict) -> None:
        back = {c: b for b, c in enumerate(word_bpe.byte_letters())}
        self.rank: dict[tuple[str, str], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((a, b), k)
        self.letter = word_bpe.byte_letters()
        # The trie over symbols 0..511: bytes, and bytes that end a word.
        self.child: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.tokens: list[list[int]] = []
        end = word_bpe.WORD_END
        for name in spec["model"]["vocab"]:
            ends = name.endswith(end)
            body = name[:-len(end)] if ends else name
            if not body or any(c not in back for c in body):
                continue
            symbols = [back[c] for c in body]
            if ends:
                symbols[-1] += 256
            if self._merged(symbols) != [tuple(symbols)]:
                continue  # no text gives this token
            node = 0
            for s in symbols:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token_at.append(-1)
                node = self.child[node][s]
            self.token_at[node] = len(self.tokens)
            self.tokens.append(symbols)
        self.fits_known: dict[tuple[int, int], bool] = {}

    def _merged(self, symbols: list[int]) -> list[tuple[int, ...]]:
        """The merges themselves, lowest rank first, on a short string."""
        names = [self.letter[s & 255] + word_bpe.WORD_END * (s >> 8) for s in symbols]
        parts = [(s,) for s in symbols]
        while len(parts) > 1:
            none = len(self.rank)
            ranks = [self.rank.get(p, none) for p in zip(names, names[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == none:
                break
            names[i:i + 2] = [names[i] + names[i + 1]]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Token b may follow token a (-1: the word's start)."""
        if a < 0:
            return True
        known = self.fits_known.get((a, b))
        if known is None:
            x, y = self.tokens[a], self.tokens[b]
            known = self._merged(x + y) == [tuple(x), tuple(y)]
            if len(self.fits_known) > 2_000_000:
                self.fits_known.clear()
            self.fits_known[a, b] = known
        return known


class Transducer:
    """Compiled on demand.  State 0 is the start of a word; a state is a tuple
    of open starts (trie place, token before, count there minus present count).
    ``move`` is a table of state x symbol class: the target state and the change
    of the count in one number, -1 where not met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.column = np.full(512, -1, dtype=np.int32)
        self.symbols: list[int] = []
        self.move = np.full((1024, 64), -1, dtype=np.int32)

    def _columns(self, symbols: np.ndarray) -> None:
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)).tolist():
            if self.column[s] < 0:
                self.column[s] = len(self.symbols)
                self.symbols.append(s)
        while len(self.symbols) > self.move.shape[1]:
            self.move = np.concatenate([self.move, np.full_like(self.move, -1)], axis=1)

    def _compile(self, state: int, column: int) -> None:
        words, symbol = self.vocabulary, self.symbols[column]
        child, token_at = words.child, words.token_at
        opened, found = [], None
        for node, before, count in self.states[state]:
            after = child[node].get(symbol)
            if after is None:
                continue
            token = token_at[after]
            if token >= 0 and found is None and words.fits(before, token):
                found = (token, count + 1)
            opened.append((after, before, count))
        if found is None:
            raise ValueError("the vocabulary lacks a token for a byte")
        token, count = found
        if symbol >= 256:
            target = 0
        else:
            kept = [(node, before, c - count) for node, before, c in opened if child[node]]
            key = (*kept, (0, token, 0))
            target = self.number.setdefault(key, len(self.states))
            if target == len(self.states):
                self.states.append(key)
                if target == len(self.move):
                    self.move = np.concatenate([self.move, np.full_like(self.move, -1)])
        self.move[state, column] = target << 8 | count + _CHANGE

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        entry = self.move[state, column]
        new = entry < 0
        if new.any():
            for s, c in set(zip(state[new].tolist(), column[new].tolist())):
                self._compile(s, c)
            entry = self.move[state, column]
        return entry

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Change of the count at each symbol of a stream of whole words; the
        sums up to word ends are the counts of tokens."""
        self._columns(symbols)
        ends = np.flatnonzero(symbols >= 256) + 1
        out, start = [], 0
        while start < len(symbols):
            if len(self.states) > STATES:
                self.reset()
                self._columns(symbols)
            near = np.searchsorted(ends, start + SLAB, side="right")
            if near > 0 and ends[near - 1] > start:
                stop = int(ends[near - 1])
                out.append(self._slab(symbols[start:stop]))
            else:
                stop = int(ends[np.searchsorted(ends, start, side="right")])
                out.append(self._long_word(symbols[start:stop]))
            start = stop
        return np.concatenate([np.empty(0, np.int16), *out])

    def _long_word(self, symbols: np.ndarray) -> np.ndarray:
        """A word longer than a slab, symbol by symbol; full tables start anew
        from the state reached."""
        state, out = 0, np.empty(len(symbols), dtype=np.int16)
        for k, symbol in enumerate(symbols.tolist()):
            if len(self.states) > 2 * STATES:
                here = self.states[state]
                self.reset()
                self._columns(symbols)
                state = self.number.setdefault(here, len(self.states))
                if state == len(self.states):
                    self.states.append(here)
            column = int(self.column[symbol])
            if self.move[state, column] < 0:
                self._compile(state, column)
            entry = int(self.move[state, column])
            state, out[k] = entry >> 8, (entry & 255) - _CHANGE
        return out

    def _slab(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, -1, dtype=np.int32)
        grid[:n] = self.column[symbols]
        grid = grid.reshape(chunks, CHUNK).T.copy()          # step x chunk
        ends = np.zeros(chunks * CHUNK, dtype=bool)
        ends[:n] = symbols >= 256
        ends = ends.reshape(chunks, CHUNK)
        synced = ends.any(axis=1)
        head = np.where(synced, ends.argmax(axis=1) + 1, CHUNK)
        out = np.zeros((CHUNK, chunks), dtype=np.int16)
        leave = np.zeros(chunks, dtype=np.int32)

        def run(which: np.ndarray, start: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
            """Chunks ``which`` from places ``first`` to ``stop``."""
            state = start.copy()
            for t in range(int(first.min(initial=CHUNK)), int(stop.max(initial=0))):
                on = np.flatnonzero((first <= t) & (t < stop) & (grid[t, which] >= 0))
                entry = self.step(state[on], grid[t, which[on]])
                state[on] = entry >> 8
                out[t, which[on]] = (entry & 255) - _CHANGE
            leave[which] = state

        tails = np.flatnonzero(synced)
        run(tails, np.zeros(len(tails), np.int32), head[tails], np.full(len(tails), CHUNK))
        tail_state = leave.copy()
        enter = np.zeros(chunks, dtype=np.int32)
        known = 0  # the scan: a synced chunk's exit is constant, others need their entry
        for k in np.flatnonzero(~synced).tolist():
            one = np.array([k])
            enter[known + 1:k + 1] = tail_state[known:k]
            run(one, enter[one], np.array([0]), np.array([CHUNK]))
            tail_state[k] = leave[k]
            known = k
        enter[known + 1:] = tail_state[known:-1]
        run(tails, enter[tails], np.zeros(len(tails), int), head[tails])
        return out.T.ravel()[:n]


class Counter:
    """Tokens of whole texts."""

    def __init__(self, path: str) -> None:
        spec = word_bpe.check(path)
        self.special = word_bpe.specials(spec)
        self.machine = Transducer(Vocabulary(spec))
        kinds = np.full(0x110000, _OTHER, dtype=np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                kinds[c] = _LETTER
            elif kind[0] == "N":
                kinds[c] = _DIGIT
            elif kind[0] == "Z" or 9 <= c <= 13 or c == 0x85:
                kinds[c] = _SPACE
        self.kinds = kinds

    def _symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a text's words, the last of each word plus 256, and the
        place in the text of each byte's character."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kinds[code]
        last = np.empty(len(code), dtype=bool)
        last[-1:] = True
        last[:-1] = (kind[:-1] != kind[1:]) | (kind[:-1] == _DIGIT)
        # A contraction starts a run of other characters, so nothing of its kind
        # stands before the apostrophe.
        mark = np.flatnonzero(code[:-1] == 0x27)
        if len(mark):
            mark = mark[(mark == 0) | (kind[mark - 1] != _OTHER)]
            pad = np.concatenate([code, np.zeros(2, code.dtype)])
            taken = np.zeros(len(mark), dtype=bool)
            for tail in word_bpe.CONTRACTIONS:
                hit = ~taken
                for k, c in enumerate(tail, 1):
                    hit &= pad[mark + k] == ord(c)
                taken |= hit
                last[mark[hit]] = False
                last[mark[hit] + len(tail)] = True
        word = kind != _SPACE
        code, last, at = code[word], last[word], np.flatnonzero(word)
        raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int32)
        if len(raw) == len(code):
            return raw + 256 * last, at
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        raw[np.cumsum(size)[last] - 1] += 256
        return raw, np.repeat(at, size)

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, special = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            cut = self.special.split(text)
            special[i] = len(cut) - 1
            parts += [word_bpe.normalise(x) for x in cut]
            owner += [i] * len(cut)
        # A line end between texts: no word goes across.
        whole = "\n".join(parts)
        if not whole:
            return special
        symbols, at = self._symbols(whole)
        stop = np.cumsum([len(x) + 1 for x in parts])
        change = self.machine.counts(symbols)
        total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        upto = total[np.searchsorted(at, stop)]
        return special + np.bincount(owner, weights=np.diff(upto, prepend=0), minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = counter(path)
        for batch in pieces(batches):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            n = mine.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
