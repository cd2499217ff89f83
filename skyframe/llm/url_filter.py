"""URL rules as one bit-parallel wildcard automaton.

Each rule is a glob over the canonical url ``.host/path``: ``*`` is any run
without ``/``, ``**`` any run at all, ``?`` one character but ``/``.  All globs
are packed into the bits of 64-bit words: bit k is the state before the k-th
symbol of some glob, and its last bit the accepting state.  One Shift-And step
per character advances all globs of a whole batch of urls at once:

    D = ((D << 1) & B[c]) | (D & S[c])        (<< carries between words)

B holds the states that c enters, S those that c may stay in (the wildcards).
Time is (characters of the longest url) x (words), whatever the text holds.
The masks are the only thing sent to executors: 16 bytes x words x distinct
characters of the rules, so rules of 1 MB take about 30 MB.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lower_ascii, packed, unpacked

_ONE = np.uint64(1)


@dataclass(frozen=True)
class UrlRule:
    """``rule`` is a host and a path such as ``example.com/en/``; ``verdict`` allow or block."""

    rule: str
    verdict: str

    def glob(self) -> str:
        """The rule fits its host, all subdomains, and all paths below its own."""
        return f"*.{_literal(self.rule)}**"


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if c in "*?\\" else c for c in text)


def _symbols(glob: str) -> list[tuple[str, str]]:
    """('c', x) a character, ('any', '') one but '/', ('run', ''), ('all', '')."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if c == "\\" and k + 1 < len(glob):
            out.append(("c", glob[k + 1]))
            k += 1
        elif c == "*":
            both = glob[k + 1 : k + 2] == "*"
            out.append(("all" if both else "run", ""))
            k += both
        else:
            out.append(("any", "") if c == "?" else ("c", c))
        k += 1
    return out


class WildcardAutomaton:
    """Multiword Shift-And over code points, for a batch of strings at once."""

    def __init__(self, globs: Sequence[str]) -> None:
        enter: list[tuple[int, str | None]] = []  # state, character; None: any but '/'
        stay: list[tuple[int, bool]] = []  # state, also on '/'
        self.starts, self.ends, bit = [], [], 0
        for glob in globs:
            self.starts.append(bit)
            for kind, c in _symbols(glob):
                if kind in ("run", "all"):
                    stay.append((bit, kind == "all"))
                else:
                    bit += 1
                    enter.append((bit, c if kind == "c" else None))
            self.ends.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        chars = sorted({ord(c) for _, c in enter if c is not None} | {ord("/")})
        self.alphabet = np.array(chars, np.uint32)
        rows = len(chars) + 1  # the last row: every other character
        self.into, self.keep = np.zeros((rows, self.words), np.uint64), np.zeros((rows, self.words), np.uint64)
        slash = chars.index(ord("/"))
        for state, c in enter:
            at = [x for x in range(rows) if x != slash] if c is None else [chars.index(ord(c))]
            self.into[at, state // 64] |= _ONE << np.uint64(state % 64)
        for state, across in stay:
            at = [x for x in range(rows) if across or x != slash]
            self.keep[at, state // 64] |= _ONE << np.uint64(state % 64)
        self.first = np.zeros(self.words, np.uint64)
        for state in self.starts:
            self.first[state // 64] |= _ONE << np.uint64(state % 64)

    def match(self, strings: Sequence[str]) -> np.ndarray:
        """Boolean matrix, strings x globs: which glob fits which whole string."""
        n = len(strings)
        out = np.zeros((n, len(self.ends)), bool)
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        kind = np.where(self.alphabet[place] == codes, place, len(self.alphabet))
        begin = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.first, (n, 1))
        left = lengths[order]
        active = n
        for step in range(int(left[0]) if n else 0):
            while active and left[active - 1] <= step:
                active -= 1
            c = kind[begin[:active] + step]
            d = state[:active]
            moved = d << _ONE
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.into[c]) | (d & self.keep[c])
        for g, end in enumerate(self.ends):
            out[order, g] = (state[:, end // 64] >> np.uint64(end % 64)) & _ONE == 1
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host lower-cased A-Z after the first ``://`` up to ``/ ? #``,
    path from there up to ``? #``; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (replacing such columns).

    The longest fitting rule wins; of rules of one length a blocking one, then
    the smaller string.  No rule fits: ``rule`` is null and ``verdict`` is
    ``default``.  Null, empty and malformed urls have empty parts, so no rule
    fits them.  Rows are judged one by one: repeated rows give repeated results,
    an empty table an empty one, and no row moves between tasks.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.rule), r.verdict != "block", r.rule))
    automaton = WildcardAutomaton([r.glob() for r in ranked])
    names = np.array([r.rule for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [default], object)

    @F.pandas_udf("rule string, verdict string")
    def judge(canonical: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in canonical:
            fits = automaton.match(batch.tolist())
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(ranked)) if len(ranked) else np.zeros(len(batch), int)
            yield pd.DataFrame({"rule": names[best], "verdict": verdicts[best]})

    host, path = url_parts(F.col(f"`{url_col}`"))
    parts = packed(pages, _host=host, _path=path)  # no column of the table can clash
    judged = parts.withColumn("_judged", judge(F.concat(F.lit("."), "_host", "_path")))
    kept = [F.col(f"_in.`{c}`").alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return judged.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), "_judged.rule", "_judged.verdict")


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose url is allowed, with their own columns."""
    return unpacked(judge_urls(packed(pages, _url=F.col(url_col)), rules, "_url", default).where("verdict = 'allow'"), pages.columns)
