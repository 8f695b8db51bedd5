"""URL filtering with a bit-parallel wildcard automaton.

Every rule is a glob over host + separator + path: its host and all subdomains, then any path that starts with its own.
In either, `*` stands for any run of characters (in a host within it) and `?` for any one. All rules are packed into Shift-And masks of as many 64-bit words as needed, and one pass over the characters of a batch
of URLs simulates all of them at once: a state moves on by a shift, the shift carries between words, and wildcard states
keep themselves. Paths are followed as far as a rule can reach. The tables (rules, bytes) are bounded by the rule list, a
parameter.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule. When no rule fits, the URL
is allowed. Of the fitting rules the longest (host and path together) wins; of equally long ones the first.
Repeated rows are judged each, very long urls in blocks of bounded size. Other columns may have any names; empty tables
give none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, per_row

#: The separator's code, outside the byte values; the number of codes.
SEPARATOR, CODES = 256, 257
#: Characters that are simulated at once: URLs times the longest of them.
BLOCK = 1 << 22


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The stated rules.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


class Automaton:
    """Shift-And masks of the rules. A rule's states: the start, then one for each code of `.host | path`; a `*` adds none
    but keeps the state before it alive."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        codes = [[*b"." + r.host.encode(), SEPARATOR, *r.path.encode()] for r in rules]
        n = sum(len(c) + 1 for c in codes)
        self.words = max(1, -(-n // 64))
        self.table, self.loops, self.start, self.ends = np.zeros((CODES, self.words), np.uint64), np.zeros((CODES, self.words), np.uint64), np.zeros(self.words, np.uint64), []
        at = 0
        for c in codes:
            self._set(self.start, at)
            self._any(self.loops, at)  # whatever stands before the host
            for code in c:
                if code == ord("*"):
                    self._any(self.loops, at)
                    continue
                at += 1
                if code == ord("?"):
                    self._any(self.table, at)
                else:
                    self._set(self.table[code], at)
            self.ends.append((at // 64, np.uint64(1) << np.uint64(at % 64)))
            at += 1
        #: how much of a path can matter
        self.reach = None if any("*" in r.path for r in rules) else max((len(r.path.encode()) for r in rules), default=0)

    @staticmethod
    def _set(mask: np.ndarray, at: int) -> None:
        mask[at // 64] |= np.uint64(1) << np.uint64(at % 64)

    def _any(self, table: np.ndarray, at: int) -> None:
        """Any code but the separator."""
        for code in range(CODES - 1):
            self._set(table[code], at)

    def matches(self, urls: list[list[int]]) -> np.ndarray:
        """urls as codes -> for each URL and rule, whether the rule's last state was reached (a rule's path may go on)."""
        width = max(map(len, urls), default=0)
        grid = np.full((len(urls), width), CODES, np.int16)
        for i, u in enumerate(urls):
            grid[i, : len(u)] = u
        # past the end no state lives on
        table, loops = (np.vstack([x, np.zeros((1, self.words), np.uint64)]) for x in (self.table, self.loops))
        state = np.tile(self.start, (len(urls), 1))
        seen = np.zeros_like(state)
        one, top = np.uint64(1), np.uint64(63)
        for column in grid.T:
            moved = state << one
            moved[:, 1:] |= state[:, :-1] >> top
            state = moved & table[column] | state & loops[column]
            seen |= state
        return np.stack([(seen[:, w] & bit) != 0 for w, bit in self.ends], axis=1) if self.rules else np.zeros((len(urls), 0), bool)


def judge(hosts: list[bytes], paths: list[bytes], automaton: Automaton) -> list[int]:
    """The index of each URL's rule, or -1."""
    rules = automaton.rules
    ranks = sorted(range(len(rules)), key=lambda r: (-len(rules[r].name), r))
    out, block, longest = [-1] * len(hosts), [], 0

    def flush() -> None:
        hit = automaton.matches([[*b"." + hosts[i], SEPARATOR, *paths[i][: automaton.reach]] for i in block])
        for k, i in enumerate(block):
            out[i] = next((r for r in ranks if hit[k, r]), -1)

    for i in sorted(range(len(hosts)), key=lambda i: len(hosts[i]) + len(paths[i])):
        longest = len(hosts[i]) + len(paths[i]) + 2
        if block and (len(block) + 1) * longest > BLOCK:
            flush()
            block = []
        block.append(i)
    flush()
    return out


def canonical(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(after, F.lit(""))


def url_filter(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits), verdict."""
    automaton = Automaton(list(rules))
    host, path = canonical(F.col("url"))
    rows = pages.select("page_id", F.col("url").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    both = rows.withColumn("both", F.concat("host", F.lit("\n"), "path"))

    def run(texts: list) -> list[list]:
        # a host holds no slash and a path is empty or starts with one, so the first slash ends the host and the \n
        ends = [t.find(b"/") - 1 if b"/" in t else len(t) - 1 for t in texts]
        found = judge([t[:e] for t, e in zip(texts, ends, strict=True)], [t[e + 1 :] for t, e in zip(texts, ends, strict=True)], automaton)
        return [[automaton.rules[i].name if i >= 0 else None for i in found], [automaton.rules[i].verdict if i >= 0 else "allow" for i in found]]

    return per_row(both, "both", run, {"rule": pa.string(), "verdict": pa.string()}, "rule string, verdict string")
