"""SentencePiece BPE encoding through a per-prefix table of last tokens, and decoding.

Let ``e(s)`` be the merge result of a string.  Two facts carry the method: a part of ``e(s)`` that lies
between token borders is the merge result of its own characters, and a sequence of tokens is the merge
result of their concatenation as soon as every neighbouring pair is the merge result of its own
concatenation.  So each prefix of a text has exactly one last token ``t``: the one that ends there (an
Aho-Corasick match) and is compatible with the last token of the prefix before it.  The table of last
tokens is filled from left to right, and the ids are read off backwards.

Merges follow the library: any two neighbours whose concatenation is a piece may merge, the piece with
the highest score first, the leftmost on ties; characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import batches_of, free_other_caches, register_cache, small_batches

SPACE = "▁"  # the library's visible space
MAX_CACHED = 250_000  # distinct words kept per worker; the table is emptied when full


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTableEncoder:
    """Encodes text with the pieces and scores of a SentencePiece BPE model."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.dummy_prefix = sp.encode("a", out_type=str) != ["a"] and sp.encode("a", out_type=str)[0].startswith(SPACE)
        self.bytes_of = {}
        pieces = {}
        for i in range(n):
            if sp.is_byte(i):
                self.bytes_of[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces[sp.id_to_piece(i)] = i
        self.unk = sp.unk_id()
        # rank: 0 merges first; pieces of one score share a rank and merge from the left
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in pieces.values()}, reverse=True))}
        self.text_of = {i: p for p, i in pieces.items()}
        self.rank = {i: order[sp.get_score(i)] for i in pieces.values()}
        self.pieces = pieces
        self.halves: dict[int, tuple[int, int] | None] = {}
        for p, i in sorted(pieces.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                self.halves[i] = None
            elif (made := self._merge(list(p))) is not None:  # else no order of merges leads to it
                self.halves[i] = made
        self.alone = {p for p in pieces if len(p) == 1}
        self._build_automaton()
        self.fits: dict[int, bool] = register_cache("sentencepiece", {})
        self.fit_key = np.full(1 << 20, -1, np.int64)  # recent answers of compatible(), by hashed pair
        self.fit_ok = np.zeros(1 << 20, bool)
        # words are independent when no reachable piece holds a space after another character
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = not any(inner.search(self.text_of[i]) for i in self.halves)
        # neighbouring characters that some piece holds: a text can be cut between any others
        self.joins = {p[k:k + 2] for p in map(self.text_of.get, self.halves) for k in range(len(p) - 1)}
        stops = {chr(c) for c in range(128) if not chr(c).isalnum()}
        while bad := {c for j in self.joins for c, d in (j, j[::-1]) if c in stops and d not in stops and d != SPACE}:
            stops -= bad
        mark = re.escape("".join(sorted(stops)))
        self.split = re.compile(f"{SPACE}*[{mark}]+|{SPACE}*[^{SPACE}{mark}]+|{SPACE}+" if stops else
                                f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.words: dict[str, tuple[tuple[int, ...], str]] = register_cache("sentencepiece", {})
        # what an id stands for on its own; bytes of longer characters only count together
        self.shown = {i: p.replace(SPACE, " ") for i, p in self.text_of.items()}
        self.shown |= {i: chr(x) for x, i in self.bytes_of.items() if x < 0x80}

    def _merge(self, symbols: list[str]) -> tuple[int, int] | None:
        """The two halves of the last merge when the symbols merge into one piece, else None."""
        pieces, rank, last = self.pieces, self.rank, None
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                i = pieces.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or rank[i] < best):
                    best, at = rank[i], k
            if at < 0:
                return None
            last = (symbols[at], symbols[at + 1])
            symbols[at:at + 2] = [last[0] + last[1]]
        return pieces[last[0]], pieces[last[1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge result of the two texts together is again (a, b).

        Walks the merges that made both sides back in time, the later one first, and looks for a pair
        across the border that would have merged earlier.  On equal rank the left merge comes first."""
        pieces, text, rank, halves = self.pieces, self.text_of, self.rank, self.halves
        before = (1 << 60, 0)  # merges across the border count if they come before this (rank, side)
        while True:
            across = pieces.get(text[a] + text[b])
            if across is not None and (rank[across], 1) < before:
                return False
            ha, hb = halves[a], halves[b]
            if ha is None and hb is None:
                return True
            # side 0: the merge lies left of the border, side 2: right of it
            at_a = (rank[a], 0) if ha is not None else (-1, 0)
            at_b = (rank[b], 2) if hb is not None else (-1, 0)
            if at_a > at_b:
                before, a = at_a, ha[1]
            else:
                before, b = at_b, hb[0]

    def _build_automaton(self) -> None:
        """Aho-Corasick automaton of the reachable pieces, as arrays over states."""
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for i in self.halves:
            at = 0
            for c in self.text_of[i]:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = i
        fail = [0] * len(children)
        hit = ends[:]  # longest piece that ends in this state
        self.shorter = np.full(max(self.halves) + 1, -1, np.int32)  # next shorter piece that ends there too
        queue = [(0, c, t) for c, t in children[0].items()]
        for at, c, t in queue:  # breadth first; the list grows while it is read
            f = fail[at]
            while f and c not in children[f]:
                f = fail[f]
            fail[t] = children[f][c] if at and c in children[f] else 0
            if ends[t] < 0:
                hit[t] = hit[fail[t]]
            else:
                self.shorter[ends[t]] = hit[fail[t]]
            queue += [(t, d, u) for d, u in children[t].items()]
        alphabet = {c: k for k, c in enumerate(sorted({c for x in children for c in x}))}
        self.letter = np.full(0x110000, -1, np.int32)
        for c, k in alphabet.items():
            self.letter[ord(c)] = k if c in self.pieces else -1
        self.width = len(alphabet)
        edges = sorted((s * self.width + alphabet[c], t) for s, x in enumerate(children) for c, t in x.items())
        self.edge_key = np.array([e[0] for e in edges], np.int64)
        self.edge_to = np.array([e[1] for e in edges], np.int32)
        self.fail, self.hit = np.array(fail, np.int32), np.array(hit, np.int32)
        self.size = np.zeros(max(self.halves) + 1, np.int32)
        for i in self.halves:
            self.size[i] = len(self.text_of[i])

    def _step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        out, todo = np.zeros_like(state), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * self.width + letter[todo]
            at = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            there = self.edge_key[at] == key
            out[todo[there]] = self.edge_to[at[there]]
            todo = todo[~there & (state[todo] != 0)]
            state[todo] = self.fail[state[todo]]
        return out

    def _fit(self, prev: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """compatible() of each pair."""
        key = prev.astype(np.int64) << 20 | tok
        slot = (key * 0x9E3779B1 >> 13) & (len(self.fit_key) - 1)
        found = {}
        for k in np.unique(key[self.fit_key[slot] != key]).tolist():
            ok = self.fits.get(k)
            if ok is None:
                if len(self.fits) > 300_000:
                    self.fits.clear()
                ok = self.fits[k] = self.compatible(k >> 20, k & 0xFFFFF)
            found[k] = ok
        miss = np.flatnonzero(self.fit_key[slot] != key)
        answer = self.fit_ok[slot]
        if len(miss):
            answer[miss] = [found[k] for k in key[miss].tolist()]
            self.fit_key[slot[miss]] = key[miss]  # of two pairs with one slot the last one stays
            self.fit_ok[slot[miss]] = [found[k] for k in self.fit_key[slot[miss]].tolist()]
        return answer

    def _known(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of stretches whose characters are all pieces: the prefix tables of all at once."""
        words_at = sorted(range(len(words)), key=lambda k: -len(words[k]))
        length = np.array([len(words[k]) for k in words_at], np.int64)
        flat = self.letter[np.frombuffer("".join([words[k] for k in words_at]).encode("utf-32-le"), np.uint32)]
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        longest = int(length[0])
        last = np.full((len(words), longest + 1), -1, np.int32)  # last[w, i]: last token of w's first i letters
        state = np.zeros(len(words), np.int32)
        for i in range(longest):
            k = int(np.searchsorted(-length, -i, "left"))  # the words longer than i
            state[:k] = self._step(state[:k].copy(), flat[start[:k] + i])
            tok = self.hit[state[:k]]
            row = np.flatnonzero(tok >= 0)
            tok = tok[row]
            while len(row):
                before = i + 1 - self.size[tok]
                ok = before == 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self._fit(last[row[rest], before[rest]], tok[rest])
                last[row[ok], i + 1] = tok[ok]
                row, tok = row[~ok], self.shorter[tok[~ok]]
                row, tok = row[tok >= 0], tok[tok >= 0]
        # backwards from the whole word, a token of every word at a time
        at, columns = length.copy(), []
        while (at > 0).any():
            tok = np.where(at > 0, last[np.arange(len(words)), at], -1)
            columns.append(tok)
            at = np.where(at > 0, at - self.size[tok], 0)
        out: list[tuple[int, ...]] = [()] * len(words)
        table = np.array(columns[::-1]).T
        first = (table < 0).sum(axis=1).tolist()  # shorter words have blanks in front
        for k, lo, ids in zip(words_at, first, table.tolist(), strict=True):
            out[k] = tuple(ids[lo:])
        return out

    def _cut(self, s: str) -> list[str]:
        """The stretch cut wherever no piece can cross."""
        joins = self.joins
        cuts = [k for k in range(1, len(s)) if s[k - 1:k + 1] not in joins]
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def _learn(self, stretches: list[str]) -> dict[str, tuple[tuple[int, ...], str]]:
        """Entries for the table of words."""
        plain, mixed, known = [], {}, set()
        for w in stretches:
            if len(w) <= 64 and self.alone.issuperset(w):
                plain.append(w)
            else:
                mixed[w] = self._cut(w)
                known.update(x for x in mixed[w] if len(x) > 1 or x in self.pieces)
        todo = sorted(known, key=len)
        ids = {}
        for group in ([x for x in todo if len(x) <= 64], *([x] for x in todo if len(x) > 64)):
            if group:
                ids.update(zip(group, self._known(group), strict=True))
        got = dict(zip(plain, self._known(plain), strict=True)) if plain else {}
        for w, parts in mixed.items():
            got[w] = tuple(chain.from_iterable(ids[x] if x in ids else self._foreign(x) for x in parts))
        return {w: (x, ",".join(map(str, x))) for w, x in got.items()}

    def _foreign(self, c: str) -> tuple[int, ...]:
        """Ids of a character outside the vocabulary."""
        if not self.bytes_of:
            return (self.unk,)
        return tuple(self.bytes_of[x] for x in c.encode("utf-8", "surrogatepass"))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """For each text its ids, and the same as decimal numbers joined by commas."""
        lead = SPACE if self.dummy_prefix else ""
        cut = []
        for t in texts:
            s = lead + t.replace(" ", SPACE)
            cut.append([] if not t else self.split(s) if self.by_word else [s])
        get = self.words.get
        found = [list(map(get, parts)) for parts in cut]
        new = {w for parts, got in zip(cut, found, strict=True) if None in got
               for w, x in zip(parts, got, strict=True) if x is None}
        if new:
            fresh = self._learn(list(new))
            if len(self.words) + len(fresh) > MAX_CACHED:
                self.words.clear()
            self.words.update(fresh)
        for parts, got in zip(cut, found, strict=True):
            if None in got:
                got = [x or fresh[w] for w, x in zip(parts, got, strict=True)]
            yield list(chain.from_iterable([x for x, _ in got])), ",".join([x for _, x in got if x])

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))[0]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, as the library gives it; it decodes runs of non-ASCII bytes itself."""
        try:
            s = "".join(map(self.shown.__getitem__, ids))
        except KeyError:
            return self.sp.decode(ids)
        return s[1:] if self.dummy_prefix and s.startswith(" ") else s


_LOADED: dict[str, PrefixTableEncoder] = {}


def encoder(model_file: str) -> PrefixTableEncoder:
    """One encoder per worker process and model."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PrefixTableEncoder(model_file)
    return _LOADED[model_file]


def encode_table(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (and ``ids`` when asked).

    A null text counts as empty: no ids, and the digests of the empty string.  Repeated rows and null ids
    come out as often as they come in; other columns of ``docs`` are not read.  No shuffle; each task
    holds one Arrow batch and a bounded table of words."""
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_other_caches("sentencepiece")
        enc = encoder(model_file)
        sha = hashlib.sha256
        for batch in small_batches(batches):
            key, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, 500_000):
                n, ids_hex, text_hex, kept = [], [], [], []
                for ids, shown in enc.encode_all(texts[lo:hi]):
                    n.append(len(ids))
                    ids_hex.append(sha(shown.encode()).hexdigest())
                    text_hex.append(sha(enc.decode(ids).encode("utf-8", "replace")).hexdigest())
                    if with_ids:
                        kept.append(ids)
                cols = [key.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                        pa.array(text_hex, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).cast("bigint").alias(id_col),
                      F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return src.mapInArrow(run, schema)
