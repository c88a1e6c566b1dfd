"""Operator 2: encoding and decoding with a published piece model, by batched Viterbi in numpy.

Words of one length advance together, one position at a time; substring hashes probe the sorted piece keys, and the
best predecessor of each position is stored as a backpointer (bpe_dp). The model at hand is a BPE model, for which the
plain Viterbi sum of scores is not what its library computes; here a step is allowed only if the pair of pieces is
stable under merging, so that of all paths exactly the library's is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bpe_dp
from pagewright.llm.common import bounded_batches, buffered

BLANK = "▁"
#: Words that a worker keeps, and characters of texts that it takes at a time: with them it stays at about 0.2 GB, of
#: which an executor has as many as cores, beside its heap.
CACHE_WORDS = 200_000
BUFFER_CHARS = 1_000_000
#: Words of one length that advance together at most: bounds the tables of a step.
TOGETHER = 12_000
UNSURE = regex.compile(r"  |\A | \Z|▁")


class PieceCodec:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)  # read for its pieces and scores only
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        ordinary = [not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n) if ordinary[i]]
        if any(s > 0 or s != round(s) for s in scores):  # a BPE model's scores are its merges' ranks, a unigram model's are logarithms
            raise ValueError("a BPE model is expected")
        if sp.encode(f"a  b{BLANK}", out_type=str)[0][:1] != BLANK or any(BLANK in s.lstrip(BLANK) for s, o in zip(names, ordinary) if o):
            raise ValueError("a model with a blank put in front, blanks kept and blanks only at the start of pieces is expected")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.n = n
        at = {s: i for i, (s, o) in enumerate(zip(names, ordinary)) if o}
        rank_of = {i: -round(sp.get_score(i)) for i in at.values()}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for s, i in at.items():
            for k in range(1, len(s)):
                if s[:k] in at and s[k:] in at:
                    pairs[at[s[:k]], at[s[k:]]] = (rank_of[i], i)
        rank: list[int | None] = [None] * n
        split: list[tuple[int, int] | None] = [None] * n
        usable = np.zeros(n, dtype=bool)
        for s, i in at.items():
            if len(s) == 1:
                usable[i] = True
            elif all(c in at for c in s):
                got, last = bpe_dp.merged([at[c] for c in s], pairs)
                if got == [i]:
                    usable[i], rank[i], split[i] = True, rank_of[i], last
        codes = [tuple(map(ord, s)) for s in names]
        self.pieces = bpe_dp.Pieces(codes, rank, split, {k: v[0] for k, v in pairs.items()}, usable)
        self.known = np.array(sorted(ord(s) for s in at if len(s) == 1))
        breaks = "" if any("\n" in s for s in at) else "\n"  # a symbol that no piece holds always stands alone
        self.words_in = regex.compile(f"{BLANK}+[^{BLANK}{breaks}]*|[^{BLANK}{breaks}]+" + (f"|{breaks}" if breaks else ""))
        self.bytes_of = [bytes([int(s[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else s.replace(BLANK, " ").encode() for i, s in enumerate(names)]
        self.cache: dict[str, bytes] = {}
        self.lossy: set[str] = set()  # words in the cache that decoding doesn't give back

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for n, at in bpe_dp.same_length(words).items():
            together = max(1, TOGETHER * 8 // max(n, 8))
            for i in range(0, len(at), together):
                part = [words[j] for j in at[i : i + together]]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n).astype(np.int64)
                unknown = np.where(self.known[np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)] == codes, -1, codes + self.n)
                last, count = self.pieces.prefixes(codes, unknown)
                for w, ids in zip(part, self._paths(last, count[:, -1])):
                    out[w] = ids
        return out

    def _paths(self, last: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
        """Follow all rows' backpointers together; the ids of each row as bytes."""
        rows, n = len(last), last.shape[1] - 1
        ids = np.zeros((rows, int(count.max())), dtype=np.int64)
        to, left, live = np.full(rows, n), count.copy(), np.arange(rows)
        while len(live):
            p = last[live, to[live]]
            left[live] -= 1
            ids[live, left[live]] = p
            to[live] -= np.where(p < self.n, self.pieces.lengths[np.minimum(p, self.n - 1)], 1)
            live = live[to[live] > 0]
        plain = (ids < self.n).all(axis=1)
        small = ids.astype(np.uint16) if self.n < 65536 else ids.astype(np.uint32)
        flat = small[np.arange(small.shape[1]) < count[:, None]].tobytes()
        ends = (np.cumsum(count, dtype=np.int64) * small.itemsize).tolist()
        for r in range(rows):
            if plain[r]:
                yield flat[ends[r - 1] if r else 0 : ends[r]]
            else:
                spelt: list[int] = []
                for p in ids[r, : count[r]].tolist():
                    spelt.extend([p] if p < self.n else self.byte_ids[list(chr(p - self.n).encode("utf-8", "surrogatepass"))].tolist())
                yield np.array(spelt, dtype=small.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each whole text, as the model's library gives them without begin and end."""
        return self.encode_checked(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The same, and whether decoding gives each text back. A text is its words' bytes in a row, so each word is decoded once, when it is new."""
        split = [regex.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", BLANK + t.replace(" ", BLANK)) if UNSURE.search(t) else [BLANK + w for w in t.split(" ")] if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.lossy.clear()
        new = set().union(*split) - self.cache.keys()
        kind = np.uint16 if self.n < 65536 else np.uint32
        parts = {w: self.words_in.findall(w) for w in new if "\n" in w or w.rfind(BLANK) > 0}
        known = self.cache
        coded = self._encode_words(list((new - parts.keys()).union(*parts.values())))
        known.update(coded)
        known.update((w, b"".join(map(coded.__getitem__, x))) for w, x in parts.items())
        self.lossy.update(self._lossy([*coded, *parts], kind))
        ids = [np.frombuffer(b"".join(map(known.__getitem__, s)), dtype=kind).astype(np.int32) for s in split]
        return ids, [BLANK not in t and (not self.lossy or self.lossy.isdisjoint(s)) for s, t in zip(split, texts)]

    def _lossy(self, words: list[str], kind: type) -> Iterator[str]:
        """Words in the cache that decoding doesn't give back. They are decoded in one go, with a byte between them that UTF-8 never has."""
        between, said = np.array([self.n], dtype=kind).tobytes(), [*self.bytes_of, b"\xff"]
        back = b"".join(map(said.__getitem__, np.frombuffer(between.join(map(self.cache.__getitem__, words)), dtype=kind).tolist()))
        asked = b"\xff".join([w.encode("utf-8", "surrogatepass") for w in words]).replace(BLANK.encode(), b" ")
        if back != asked:
            yield from (w for w, a, b in zip(words, asked.split(b"\xff"), back.split(b"\xff")) if a != b)

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding put in front goes. Bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """docs with `piece_ids` (array<int>), `n_pieces` and `round_trip` (whether decoding gives the text back).

    Null texts count as empty: no ids, round_trip true. Texts that hold U+2581 come back with blanks there, as with the
    library; their round_trip is false. Columns of these names in docs are replaced; repeated rows are coded each."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("piece_ids array<int>, n_pieces int, round_trip boolean")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in buffered((x.rename("text").to_frame() for x in batches), chars=BUFFER_CHARS):
            texts = [t if isinstance(t, str) else "" for t in b["text"].tolist()]
            ids, same = c.encode_checked(texts)
            yield pd.DataFrame({"piece_ids": ids, "n_pieces": np.array([len(x) for x in ids], dtype=np.int32), "round_trip": same})

    kept = docs.drop("piece_ids", "n_pieces", "round_trip")
    return kept.withColumn("__pieces_coded__", coded(F.col(text_column))).select(*[F.col(f"`{c}`") for c in kept.columns], "__pieces_coded__.*")


def decode_pieces(df: DataFrame, path: str, ids_column: str = "piece_ids", out_column: str = "text") -> DataFrame:
    """df with the text of its ids; null ids give null, an empty array the empty text."""
    @F.pandas_udf("string")
    def decoded(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path)
        for batch in ids:
            yield pd.Series([None if x is None else c.decode(list(x)) for x in batch], dtype=object)

    return df.withColumn(out_column, decoded(F.col(ids_column)))
