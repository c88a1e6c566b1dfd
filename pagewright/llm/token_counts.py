"""Operator 9: token counts by prefix dynamic programming over byte pairs.

`TokenCounter.prefix_counts` has the exact count of every prefix of a text. A word's table, the counts of its prefixes, is
computed once per worker and kept; a text's counts are its words' tables laid end to end, each raised by what came before
it. How long a text is, whether it goes over a limit, and where to cut it for a budget are read off that array, nothing
is encoded again: `measure` does so by the sums at word ends and the table of the one word that holds the cut.
`token_counts` does so for a table, `prefix_token_counts` hands whole arrays out.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import bpe_dp
from pagewright.llm.common import bounded_batches

# The published split rule of byte-level BPE tokenizers of this family.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: More white space beside a blank, or a blank at an end: there, a blank alone doesn't tell where a word begins.
UNSURE = re.compile(r" \s|\s |\A | \Z")
#: Contractions that are a word of the split rule only when whole.
CONTRACTIONS = ("'re", "'ve", "'ll")
SPACES = regex.compile(r"\s{2,}")
#: Marks that are one word of the split rule together, at the end of a chunk.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longer words' tables are computed each time.
CACHE_CHARS = 64
CACHE_WORDS = 600_000
CACHE_PAIRS = 1_000_000
#: Above this code point the split is left to the library's own splitter, whose Unicode tables may be newer.
COMMON = regex.compile("[^\\x00-\\u052f]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in such vocabularies: printable Latin-1 stands for itself, the rest is moved past U+0100."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(moved)}


class TokenCounter:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)  # for its splitter only
        spec = json.load(open(path, encoding="utf-8"))
        model, of = spec["model"], byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab: dict[str, int] = model["vocab"]
        names = sorted(vocab, key=vocab.__getitem__)
        at = {s: i for i, s in enumerate(names)}
        pieces = [tuple(of[c] for c in s) for s in names]
        rank: list[int | None] = [None] * len(names)
        split: list[tuple[int, int] | None] = [None] * len(names)
        pairs: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = (at[a], at[b])
            pairs[pair] = r
            made = at[a + b]
            if rank[made] is None:
                rank[made], split[made] = r, pair
        usable = np.array([len(p) == 1 or s is not None for p, s in zip(pieces, split)])
        self.pieces = bpe_dp.Pieces(pieces, rank, split, pairs, usable)
        self.matches = ahocorasick.Automaton()
        for i, p in enumerate(pieces):
            if usable[i]:
                self.matches.add_word(bytes(p).decode("latin-1"), i)
        self.matches.make_automaton()
        self.lengths = self.pieces.lengths.tolist()
        self.pairs = pairs
        self.made, self.left, self.right = (x.tolist() for x in (self.pieces.made, self.pieces.left, self.pieces.right))
        self.stable: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}  # of words of the split rule: 32-bit counts of each prefix, in code points
        self._forget()

    def prefix_table(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i], data being one word of the split rule. Each prefix ends in one piece (see bpe_dp)."""
        stable, compute, lengths = self.stable, self._stable, self.lengths
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, p in self.matches.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:  # found, and there is only one
                continue
            if j := end - lengths[p]:
                key = last[j] << 32 | p
                ok = stable.get(key)
                if ok is None:
                    ok = compute(key)
                if not ok:
                    continue
            last[end], count[end] = p, count[j] + 1
        return count

    def _stable(self, key: int) -> bool:
        """Whether two adjacent pieces stay as they are; see Pieces.stable, of which this is the form for one pair."""
        if len(self.stable) > CACHE_PAIRS:
            self.stable.clear()
        x, y, limit, ok = key >> 32, key & 0xFFFFFFFF, 1 << 60, True
        while True:
            if self.pairs.get((x, y), limit) < limit:
                ok = False
                break
            mx, my = self.made[x], self.made[y]
            if mx < 0 and my < 0:
                break
            if mx > my:
                limit, x = mx, self.right[x]
            else:
                limit, y = my + 1, self.left[y]
        self.stable[key] = ok
        return ok

    def split(self, text: str) -> list[str]:
        if COMMON.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def _counts_of(self, word: str) -> list[int]:
        """Counts of each prefix of one word of the split rule, from its first code point on."""
        data = word.encode("utf-8", "surrogatepass")
        count = self.prefix_table(data)
        if len(data) == len(word):
            return count[1:]
        return [n for n, b in zip(count[1:], data[1:] + b"a") if b & 0xC0 != 0x80]  # only where a code point ends

    def _table(self, word: str) -> bytes:
        """The same as 32-bit numbers; short words' are kept."""
        table = self.tables.get(word)
        if table is None:
            table = array("i", self._counts_of(word)).tobytes()
            if len(word) <= CACHE_CHARS:
                if len(self.tables) > CACHE_WORDS:
                    self.tables.clear()
                self.tables[word] = table
        return table

    def _chunk(self, text: str) -> bytes:
        """The table of what stands between two blanks, with its blank in front. Most are one word, which needn't be kept twice."""
        if text[1:].isalpha() and max(text) < "\u0530":
            return array("i", self._counts_of(text)).tobytes()
        if "'" in text or SPACES.search(text):
            return self._ordinary(text).astype(np.int32).tobytes()
        out, base = array("i"), 0
        for w in self.split(text):
            counts = self._counts_of(w) if len(w) > 3 else array("i", self._table(w))
            out.extend([base + n for n in counts] if base else counts)
            base = out[-1]
        return out.tobytes()

    @staticmethod
    def _laid(tables: list[bytes]) -> np.ndarray:
        """Tables end to end, each raised by the last counts of those before it."""
        flat = np.frombuffer(b"".join(tables), dtype=np.int32)
        size = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables)) // 4
        last = flat[np.cumsum(size) - 1]
        return flat + np.repeat(np.cumsum(last) - last, size)

    def _ordinary(self, text: str) -> np.ndarray:
        """Counts of text[:1], text[:2], ... where no special token is.

        A prefix that ends inside a word has that word's prefix as its last word, but in two places: white space at a
        prefix's end is one word, though in the text its last blank may go with what follows; and a contraction that
        isn't whole yet is an apostrophe and a letter."""
        words = self.split(text)
        if not words:
            return np.zeros(0, dtype=np.int64)
        whole = self._laid([self._table(w) for w in words])
        out = whole.astype(np.int64)
        for m in SPACES.finditer(text):
            a, b = m.span()
            out[a:b] = (whole[a - 1] if a else 0) + np.frombuffer(self._table(m[0]), dtype=np.int32)
        if "'" in text:
            at = 0
            for w in words:
                if w in CONTRACTIONS:
                    out[at + 1] = (whole[at - 1] if at else 0) + 1 + np.frombuffer(self._table(w[1]), dtype=np.int32)[0]
                at += len(w)
        return out

    def _forget(self) -> None:
        """Tables of chunks, of what stands between blanks, its blank in front included: by number, with each one's last count."""
        self.chunks: dict[str, int] = {}
        self.chunk_tables: list[bytes] = []
        self.chunk_last = np.zeros(1024, dtype=np.int64)

    def _numbered(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks ' word'; their tables stay for later texts."""
        try:
            return np.fromiter(map(self.chunks.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        except KeyError:
            pass
        if len(self.chunks) > CACHE_WORDS:
            self._forget()
        for c in chunks:
            if c not in self.chunks:
                core = c.rstrip(MARKS)
                if core != c and core.isalpha() and max(core) < "\u0530":  # a word and marks: most words come with and without
                    if core not in self.chunks:
                        self._keep(core, self._chunk(" " + core))
                    word, after = self.chunk_tables[self.chunks[core]], array("i", self._table(c[len(core) :]))
                    last = int.from_bytes(word[-4:], sys.byteorder)
                    self._keep(c, word + array("i", [last + n for n in after]).tobytes())
                else:
                    self._keep(c, self._chunk(" " + c))
        return np.fromiter(map(self.chunks.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def _keep(self, chunk: str, table: bytes) -> None:
        k = self.chunks[chunk] = len(self.chunk_tables)
        self.chunk_tables.append(table)
        if k == len(self.chunk_last):
            self.chunk_last = np.concatenate((self.chunk_last, np.zeros(k, dtype=np.int64)))
        self.chunk_last[k] = int.from_bytes(table[-4:], sys.byteorder)

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens, code points of the longest prefix that has at most `budget` of them)."""
        if UNSURE.search(text) or any(s in text for s in self.special):
            counts = self.prefix_counts(text)
            return int(counts[-1]), longest(counts, budget)
        parts = text.split(" ")
        first = np.concatenate(([0], self._ordinary(parts[0])))
        at = self._numbered(parts[1:])
        ends = first[-1] + np.cumsum(self.chunk_last[at])
        total = int(ends[-1]) if len(ends) else int(first[-1])
        if total <= budget:
            return total, len(text)
        k = int(np.searchsorted(ends, budget))  # chunks that end below the budget; the next one's blank fits in as well
        if k == 0 and first[-1] >= budget:
            return total, longest(first, budget)
        before = int(ends[k - 1]) if k else int(first[-1])
        table = np.concatenate(([0], np.frombuffer(self.chunk_tables[at[k]], dtype=np.int32)))
        return total, len(parts[0]) + sum(map(len, parts[1 : k + 1])) + k + longest(table, budget - before)

    def _special(self, text: str) -> np.ndarray:
        """Counts of text[:1], ... with special tokens in it: a special token that isn't whole yet is ordinary text."""
        out, base, start = [], 0, 0
        cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        while m := cut.search(text, start):
            near = self._ordinary(text[start : m.end() - 1]) + base
            at = m.start() - start
            base = (int(near[at - 1]) if at else base) + 1
            out += [near, [base]]
            start = m.end()
        return np.concatenate([*out, self._ordinary(text[start:]) + base])

    def counts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, counts[i]: tokens of text[:i] encoded by itself, i from 0 to its length in code points."""
        for t in texts:
            if any(s in t for s in self.special):
                found = self._special(t)
            elif not t or UNSURE.search(t):
                found = self._ordinary(t)
            else:
                p = t.split(" ")
                at = self._numbered(p[1:])
                found = self._laid([self._ordinary(p[0]).astype(np.int32).tobytes(), *[self.chunk_tables[k] for k in at.tolist()]])
            yield np.concatenate(([0], found))

    def prefix_counts(self, text: str) -> np.ndarray:
        return next(self.counts([text]))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, as the library gives them without begin, end and added special tokens."""
        return [self.measure(t, 0)[0] for t in texts]

    def fit(self, text: str, budget: int) -> int:
        return self.measure(text, budget)[1]


def longest(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix that has at most `budget` tokens (0 or more). Counts needn't rise with every character."""
    return int(np.flatnonzero(counts <= budget)[-1])


def longest_prefix(counts: Column, budget: int) -> Column:
    """The same of a column of prefix counts, in the JVM."""
    return F.size(counts) - F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), True)


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit, fit_chars (code points of the longest prefix with at most `limit` tokens).

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and ids are counted each. Other columns aren't read."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            out = []
            for t in texts:
                n, cut = c.measure(t, limit)
                out.append((len(t.encode("utf-8", "surrogatepass")), n, n > limit, cut))
            yield pd.DataFrame(out, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.select(id_column, counted(F.col(text_column)).alias("r")).select(id_column, "r.*")


def prefix_token_counts(docs: DataFrame, path: str, text_column: str = "text", out_column: str = "prefix_counts") -> DataFrame:
    """docs with the token count of each prefix of its text, from none of it to all (array<int>); see longest_prefix. A null text is empty. A column of that name is replaced."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for batch in batches:
            yield pd.Series([n.astype(np.int32) for n in c.counts([t if isinstance(t, str) else "" for t in batch])], dtype=object)

    return docs.withColumn(out_column, counted(F.col(text_column)))
