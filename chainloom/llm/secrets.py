"""Secret scans: every rule in one byte pass of a combined automaton, which tells where spans begin."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.automaton import Automaton, Scanner, compile_rules
from chainloom.llm.common import Batches, in_slices


@dataclass(frozen=True)
class Rule:
    """pattern: what a span is; a match counts if its group has least characters or more. compiled: the expression that
    the automaton has, the pattern itself unless a counted one gives the same spans: where no match that is too short can
    hide a longer one, since matches are whole runs of characters, the count keeps the automaton quiet on plain words."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    either_case: bool = False
    counted: str | None = None

    @property
    def compiled(self) -> str:
        return self.counted or self.pattern


_KEYED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

BASE = (
    Rule("assign", _KEYED + r"([A-Za-z0-9+/_.=-]+)", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, counted=r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]+", 16, counted=r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 16),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
)
RULES = BASE + MORE


@lru_cache
def automata(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, tuple[Automaton, ...]]:
    """The backward automaton of all rules, and the forward one of each."""
    parts = [(r.kind, r.compiled, r.either_case) for r in rules]
    return compile_rules(parts, backward=True), tuple(compile_rules([part], search=False) for part in parts)


def find(text: str, scanner: Scanner, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of every span of a text, by start, then the rules' order. The automata give the
    matches; the length of a match's group is checked by the expression on the match alone."""
    data = text.encode("utf-8", "surrogatepass")
    found, at, chars = [], 0, 0
    for start, k, end in scanner.spans(data):
        chars += len(data[at:start].decode("utf-8", "surrogatepass"))
        at, match = start, data[start:end].decode("ascii")
        r = rules[k]
        if len(re.fullmatch(r.pattern, match, re.ASCII | re.IGNORECASE * r.either_case).group(r.group)) >= r.least:
            found.append((r.kind, chars, chars + len(match)))
    return found


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(compiled: tuple[Automaton, tuple[Automaton, ...]], rules: Sequence[Rule]):
    def of(batches: Batches) -> Batches:
        scanner = Scanner(*compiled)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t or "", scanner, rules)] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, _SPANS)], names=["row", "spans"])

    return of


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: the columns to keep and spans, an array of (kind, start, end) by start, then the
    rules' order; start and end count code points, end is exclusive.

    The automata are compiled on the driver and go to the tasks as arrays; a text of any length is one pass over its
    bytes, and a second one to note places if it has a match. Null text: as empty, no spans. Rows that repeat are scanned each. No shuffle. No documents: no rows.
    """
    rows = docs.select(F.struct(*keep).alias("row"), "text")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_scan(automata(tuple(rules)), tuple(rules)), schema).select("row.*", "spans")


def redact(text: str, found: Sequence[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced together."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
