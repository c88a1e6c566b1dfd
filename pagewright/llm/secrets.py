"""Operator 3: secret scans with one deterministic automaton for all rules.

The rules' regexes, reversed, become one nondeterministic automaton; subset construction and minimisation turn it into
transition arrays. One pass over a text's bytes, last byte first, then tells every place where a match of some rule
begins. From these the leftmost non-overlapping matches of each rule are taken, each ending where its regex, anchored
at that place, ends. Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches


@dataclass(frozen=True)
class Rule:
    """kind; regex; group whose length is checked after matching, and the least length. `begin` is a regex of which
    every place where `regex` matches is a match as well: what the automaton looks for. It may be shorter than `regex`, if
    a failed match that begins there reads no more than a bounded number of characters, or only such as no other reads:
    scanning a text then takes time in proportion to its length."""

    kind: str
    regex: str
    begin: str
    group: int = 0
    least: int = 1


# The three base kinds. `{24,}` and `{16,}` find just what `+` and a check of the length find, as the
# class's runs are maximal and a later start in a run is shorter. For `assign` a short match uses up its text.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]"),
    Rule("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
)
# What follows a private key's first line: all up to its END line, if no other BEGIN comes before; else, as of a key that
# was cut off, header lines and lines of base64, the last of which may be short. Line ends may be written as \\n.
KEY_TO_END = r"(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]{0,20}PRIVATE KEY-----"
GAP = r"(?:[\x20\t\r\n]|\\[rn])*"
KEY_LINES = rf"(?:{GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*(?:(?:{GAP}[A-Za-z0-9+/]{{20,}}={{0,2}})+(?:{GAP}[A-Za-z0-9+/]{{1,19}}={{0,2}}(?=[\x20\t]*(?:[\r\n\\]|\Z)))?)?"
# Published formats of further credentials.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", r"AIza[0-9A-Za-z_-]"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}", r"[sr]k_live_[0-9A-Za-z]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8}"),
    Rule("private_key", rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:{KEY_TO_END}|{KEY_LINES})", r"-----BEGIN [A-Z ]"),
)
RULES = BASE + EXTRA


class _Nfa:
    """Thompson's construction over bytes, of the reversed regex."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def chars(self, at: int, allowed: frozenset[int]) -> int:
        to = self.state()
        mid = self.state()
        self.empty[at].append(mid)
        self.step[mid] = (allowed, to)
        return to

    def add(self, tree, at: int, fold: bool) -> int:
        for op, arg in reversed(list(tree)):
            at = self.one(str(op), arg, at, fold)
        return at

    def one(self, op: str, arg, at: int, fold: bool) -> int:
        if op == "LITERAL":
            return self.chars(at, _folded({arg}, fold))
        if op == "IN":
            return self.chars(at, _folded(_members(arg), fold))
        if op == "SUBPATTERN":
            return self.add(arg[3], at, fold or bool(arg[1] & re.IGNORECASE))
        if op == "BRANCH":
            end = self.state()
            for branch in arg[1]:
                self.empty[self.add(branch, at, fold)].append(end)
            return end
        if op == "MAX_REPEAT":
            least, most, body = arg
            for _ in range(least):
                at = self.add(body, at, fold)
            if str(most) == "MAXREPEAT":
                head = self.state()
                self.empty[at].append(head)
                self.empty[self.add(body, head, fold)].append(head)
                return head
            end = self.state()
            for _ in range(most - least):
                self.empty[at].append(end)
                at = self.add(body, at, fold)
            self.empty[at].append(end)
            return end
        raise ValueError(f"not in the supported regex subset: {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def _members(items) -> set[int]:
    out: set[int] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(arg)
        elif str(op) == "RANGE":
            out.update(range(arg[0], arg[1] + 1))
        else:
            raise ValueError(f"not in the supported regex subset: {op}")
    return out


def _folded(chars: set[int], fold: bool) -> frozenset[int]:
    if max(chars) > 127:
        raise ValueError("rules are ASCII")
    return frozenset(chars | {ord(chr(c).swapcase()) for c in chars}) if fold else frozenset(chars)


def transitions(begins: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Minimal automaton of any text followed by a reversed match: (states, 256) next states from state 0, and each state's rules as a bit mask."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for k, regex in enumerate(begins):
        own = nfa.state()
        nfa.empty[start].append(own)
        ends[nfa.add(re._parser.parse(regex), own, False)] = 1 << k
    signature: dict[tuple, int] = {}
    sets = [s[0] for s in nfa.step if s]
    byte_class = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    example = [int(np.flatnonzero(byte_class == k)[0]) for k in range(len(signature))]
    first = nfa.closure([start])
    number, todo, table, marks = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        marks.append(sum({ends[s] for s in now if s in ends}))
        row = []
        for b in example:
            to = nfa.closure([start, *(nfa.step[s][1] for s in now if nfa.step[s] and b in nfa.step[s][0])])
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
    full, mark = np.array(table), np.array(marks)
    block = np.unique(mark, return_inverse=True)[1]
    while True:  # states that differ in no continuation fall together
        finer = np.unique(np.column_stack([block, block[full]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = list(dict.fromkeys(block.tolist()))  # the first state's block gets number 0
    new = np.empty(len(order), dtype=np.int64)
    new[order] = np.arange(len(order))
    picked = [int(np.flatnonzero(block == b)[0]) for b in order]
    return new[block[full[picked]]][:, byte_class], mark[picked]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regexes = [re.compile(r.regex.encode()) for r in rules]
        table, mark = transitions([r.begin for r in rules])
        self.states = len(table)
        rows: list[list] = [[] for _ in table]
        for r, to, m in zip(rows, table.tolist(), mark.tolist()):
            r.extend(rows[t] for t in to)  # a state is its row, so a step is one look-up
            r.append(m)
        self.first = rows[0]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then by the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        row = self.first
        for b in reversed(data):
            row = row[b]
            if row[256]:
                break
        else:
            return []
        begins: list[list[int]] = [[] for _ in self.rules]
        row, i = self.first, len(data)
        for b in reversed(data):
            i -= 1
            row = row[b]
            if row[256]:
                for k in range(len(self.rules)):
                    if row[256] >> k & 1:
                        begins[k].append(i)
        found = []
        for k, rule in enumerate(self.rules):
            free = 0
            for i in reversed(begins[k]):
                if i >= free and (m := self.regexes[k].match(data, i)):
                    free = m.end()
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.append((i, k, m.end()))
        found.sort()
        if len(data) == len(text):
            return [(self.rules[k].kind, i, e) for i, k, e in found]
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
        return [(self.rules[k].kind, int(points[i]), int(points[e])) for i, k, e in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """docs with a column `secret_spans`: array of (kind, start, end). Null texts are empty and hold none.

    Every row is scanned whole, repeated rows each. A column of that name in docs is replaced; others pass through."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scanner(rules)
        for batch in texts:
            yield pd.Series([[{"kind": k, "start": a, "end": e} for k, a, e in s.scan(t)] if isinstance(t, str) else [] for t in batch])

    return docs.withColumn("secret_spans", spans(F.col(text_column)))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with the text of every span replaced by `mark`; spans that touch or overlap become one mark. Null texts stay null."""
    bounded_batches(docs.sparkSession)

    def clean(s: Scanner, t: str) -> str:
        found = s.scan(t)
        if not found:
            return t
        out, at = [], 0
        for _, a, e in found:
            if a > at or not out:
                out += [t[at:a], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    @F.pandas_udf("string")
    def redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = scanner(rules)
        for batch in texts:
            yield pd.Series([clean(s, t) if isinstance(t, str) else None for t in batch], dtype=object)

    return docs.withColumn(text_column, redacted(F.col(text_column)))


def secret_digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts and digests of the spans of each row; the base kinds by themselves, and all spans as text."""
    found = scan_secrets(docs.select(id_column, text_column), RULES, text_column)
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("secret_spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        id_column,
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secret_spans", said), ",").alias("spans"),
    )
