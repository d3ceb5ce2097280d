"""Secret scans: a trigram inverted index chooses the documents in which each rule's regular expression is tried.

For each rule a Boolean trigram query is derived from its expression's syntax tree: literal runs become strings,
alternatives unions, sequences products; strings of three bytes or more give AND of their trigrams. Per batch, postings
of the needed trigrams are built over lower-cased bytes, the queries intersect and unite them, and only candidates
are matched. A rule without mandatory trigrams scans all documents (runs of a byte class through a vectorised scan).

Every rule takes time in proportion to a text, also a hostile one: what may run long is anchored where it starts. Spans
are in code points, end exclusive. Null and empty texts have none. Repeated rows are scanned alike.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import LOWER, chunks, text_bytes
from .rows import add_columns, code_points


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  #: of which the length counts
    shortest: int = 0
    base: bool = False


#: fixed values: kinds, patterns and least lengths
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chatbot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
FIELD = T.StructType([T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

Query = tuple | bool  #: True, a trigram, or ("and" | "or", parts)
_MOST = 64


def _strings(node: tuple) -> set[str] | None:
    """All strings a syntax node matches, lower-cased, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2 and (one := _sequence(arg[2])) is not None:
        out: set[str] = set()
        for n in range(arg[0], arg[1] + 1):
            many = {""}
            for _ in range(n):
                many = {a + b for a in many for b in one}
            out |= many
        return out if len(out) <= _MOST else None
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        if (s := _strings(node)) is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _all(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return ("and", tuple(parts)) if len(parts) > 1 else parts[0] if parts else True


def _any(parts: list[Query]) -> Query:
    return True if True in parts else ("or", tuple(parts)) if len(parts) > 1 else parts[0]


def _of_strings(strings: set[str]) -> Query:
    return _any([_all([t[i : i + 3].encode() for i in range(len(t) - 2)]) for t in sorted(strings)])


def _required(nodes) -> Query:
    done: list[Query] = []
    exact = {""}
    for node in nodes:
        s = _strings(node)
        if s is not None and len(exact) * len(s) <= _MOST:
            exact = {a + b for a in exact for b in s}
            continue
        done.append(_of_strings(exact))
        exact = s or {""}
        if s is None:
            op, arg = node
            if op is C.SUBPATTERN:
                done.append(_required(arg[3]))
            elif op is C.BRANCH:
                done.append(_any([_required(x) for x in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                done.append(_required(arg[2]))
    return _all([*done, _of_strings(exact)])


def trigram_query(pattern: str) -> Query:
    """What every match's text must hold, as AND and OR of lower-cased trigrams; True if nothing is mandatory."""
    return _required(P.parse(pattern))


def _trigrams(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*(_trigrams(q) for q in query[1]))


def _run_of(pattern: str, shortest: int) -> np.ndarray | None:
    """The byte class, if the whole rule is one class repeated: then its runs are found without a regular expression."""
    tree = list(P.parse(pattern))
    if len(tree) == 1 and tree[0][0] is C.MAX_REPEAT and tree[0][1][1] is C.MAXREPEAT and shortest > 1:
        one = re.compile(pattern.rstrip("+").encode())
        return np.array([bool(one.fullmatch(bytes([b]))) for b in range(256)]) if pattern.endswith("]+") and pattern.startswith("[") else None
    return None


class Scanner:
    """Compiled rules; one per worker process and rule set."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern.encode()) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.classes = [_run_of(r.pattern, r.shortest) if q is True else None for r, q in zip(rules, self.queries, strict=True)]
        self.grams = sorted(set().union(*(_trigrams(q) for q in self.queries)))
        self.ids = np.zeros(1 << 24, np.uint8 if len(self.grams) < 255 else np.uint16)
        for k, g in enumerate(self.grams):
            self.ids[g[0] << 16 | g[1] << 8 | g[2]] = k + 1

    def candidates(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Per rule, whether each document (bytes at[d]..at[d+1]) may hold a match."""
        n = len(at) - 1
        low = LOWER[data].astype(np.int32)
        found = self.ids[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(low) > 2 else np.zeros(0, self.ids.dtype)
        where = np.flatnonzero(found)
        docs, grams = np.searchsorted(at, where, side="right") - 1, found[where]
        postings = {g: np.unique(docs[grams == k + 1]) for k, g in enumerate(self.grams)}

        def holds(q: Query) -> np.ndarray:
            if q is True:
                return np.ones(n, bool)
            if isinstance(q, bytes):
                out = np.zeros(n, bool)
                out[postings[q]] = True
                return out
            return (np.logical_and if q[0] == "and" else np.logical_or).reduce([holds(x) for x in q[1]])

        out = []
        for rule, query, members in zip(self.rules, self.queries, self.classes, strict=True):
            if members is None:
                out.append(holds(query))
                continue
            run, length = members[data], 1
            while length < rule.shortest and len(run):
                step = min(length, rule.shortest - length)
                run, length = run[:-step] & run[step:], length + step
            some = np.zeros(n, bool)
            some[np.searchsorted(at, np.flatnonzero(run), side="right") - 1] = True
            out.append(some)
        return out

    def scan(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[str, int, int]]]:
        out: list[list] = [[] for _ in range(len(off) - 1)]
        for i, j in chunks(off):
            part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
            for k, may in enumerate(self.candidates(part, at)):
                rule, regex = self.rules[k], self.compiled[k]
                for d in np.flatnonzero(may).tolist():
                    raw = part[at[d] : at[d + 1]].tobytes()
                    out[i + d] += [(k, *m.span()) for m in regex.finditer(raw) if m.end(rule.group) - m.start(rule.group) >= rule.shortest]
            for d in range(i, j):
                if out[d]:
                    cp = code_points(data[off[d] : off[d + 1]])
                    out[d] = [(self.rules[k].kind, int(cp[a]), int(cp[b])) for k, a, b in sorted(out[d], key=lambda x: (x[1], x[0]))]
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with secrets: array of (kind, start, end), by start, then by the rules' order."""
    return add_columns(docs, FIELD, lambda batch: [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for spans in _scanner(rules).scan(*text_bytes(batch.column(text)))]])


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with every secret's span replaced by `mark` (overlapping spans by one); documents without secrets unchanged."""

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for t, spans in zip(batch.column(text).to_pylist(), _scanner(rules).scan(*text_bytes(batch.column(text))), strict=True):
            parts, done = [], 0
            for _, a, b in spans:
                if a >= done:
                    parts += [t[done:a], mark]
                done = max(done, b)
            out.append("".join([*parts, t[done:]]) if spans else t)
        return [out]

    new = T.StructType([T.StructField("_mw_clean", T.StringType())])
    return add_columns(docs, new, make).withColumn(text, F.col("_mw_clean")).select(*docs.columns)


