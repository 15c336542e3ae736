"""URL filter: all glob rules run at once over each canonical URL as one bit-parallel automaton.

A rule such as ``example.net/en/`` fits its host, every subdomain and every path with its prefix. It becomes two globs
over ``host`` + ``path``: ``example.net/en/**`` and ``*.example.net/en/**``, where ``*`` runs over any byte but ``/`` and
``**`` over any byte. All globs are packed into 64-bit words as a Shift-And automaton (one bit per glob position, a
carry between words), and the states of all URLs of a batch advance together, byte by byte. A URL leaves the batch as
soon as no bit can change any more, so the work is bounded by the host and the longest rule, not by the path.

Defined results: a null url or one without ``://`` has empty host and path and no rule; only A-Z are lower-cased; the
longest rule text wins, at equal length ``block``; without a fitting rule the verdict is the default. Repeated and null
ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgrid.llm.text import text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)
DEFAULT_VERDICT = "allow"


def canonical_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns of a url column, empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class GlobAutomaton:
    """Shift-And masks of all globs of a rule list."""

    def __init__(self, rules: Sequence[UrlRule]):
        self.rules = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block"))
        bits = sum(2 * len(r.text.encode()) + 2 + 1 for r in self.rules)
        self.width = bits // 64 + 1
        take = np.zeros((256, self.width), np.uint64)  # bytes that move a state onwards to this bit
        stay = np.zeros((256, self.width), np.uint64)  # bytes that keep this bit
        self.start = np.zeros(self.width, np.uint64)
        self.final: list[list[int]] = []
        bit = 0

        def put(masks: np.ndarray, at: int) -> None:
            masks[..., at // 64] |= np.uint64(1 << (at % 64))

        no_slash = np.array([b for b in range(256) if b != ord("/")])
        for rule in self.rules:
            ends = []
            for wild in (False, True):
                literal = (b"." if wild else b"") + rule.text.encode()
                # the state before the literal; for *.host it may run on over the subdomain
                put(self.start, bit)
                if wild:
                    masks = stay[no_slash]
                    put(masks, bit)
                    stay[no_slash] = masks
                for i, byte in enumerate(literal):
                    put(take[byte], bit + 1 + i)
                bit += len(literal)
                put(stay, bit)  # ** after the rule: once reached, for good
                ends.append(bit)
                bit += 1
            self.final.append(ends)
        self.take = np.zeros((256, (bit + 63) // 64), np.uint64)
        self.width = self.take.shape[1]
        self.take[:] = take[:, : self.width]
        self.stay = stay[:, : self.width].copy()
        self.start = self.start[: self.width]
        self.done = np.zeros(self.width, np.uint64)
        for ends in self.final:
            for end in ends:
                put(self.done, end)

    def first_rule(self, urls: list[bytes]) -> np.ndarray:
        """Index of the winning rule per URL, -1 for none."""
        n = len(urls)
        states = np.repeat(self.start[None, :], n, axis=0)
        lengths = np.fromiter(map(len, urls), np.int64, n)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        data = np.frombuffer(b"".join(urls), np.uint8)
        alive = np.flatnonzero(lengths)
        step = 0
        while len(alive):
            now, byte = states[alive], data[offsets[alive] + step]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            now = (shifted & self.take[byte]) | (now & self.stay[byte])
            states[alive] = now
            step += 1
            alive = alive[((now & ~self.done) != 0).any(axis=1) & (lengths[alive] > step)]
        best = np.full(n, -1)
        for i in range(len(self.rules) - 1, -1, -1):
            for end in self.final[i]:
                best[(states[:, end // 64] >> np.uint64(end % 64) & np.uint64(1)) == 1] = i
        return best


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[UrlRule] = RULES,
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one per input row."""
    host, path = canonical_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    fixed = tuple(rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(fixed)
        names = [r.text for r in automaton.rules] + [None]
        verdicts = [r.verdict for r in automaton.rules] + [default]
        for batch in batches:
            urls = [h + p for h, p in zip(text_bytes(batch.column("host")), text_bytes(batch.column("path")))]
            best = automaton.first_rule(urls)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([names[i] for i in best], pa.string()),
                 pa.array([verdicts[i] for i in best], pa.string())],
                [*batch.schema.names, "rule", "verdict"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
