"""Secret scans by one combined deterministic automaton.

All rules are compiled together. A single pass over a text's bytes, from its end to its start, marks every
position where some rule's match begins: read backwards, the automaton of the mirrored rules accepts there.
Only from a mark does a rule's own forward automaton run, to find the longest end. So a text without secrets
costs one table look-up a byte, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import compile_rules, parse, reverse
from .common import rows_of, text_batches


@dataclass(frozen=True)
class Rule:
    """A pattern over bytes; ``keep`` sees a match and may drop it (it still hides later overlapping ones)."""

    kind: str
    pattern: str
    ignore_case: bool = False
    keep: Callable[[bytes], bool] | None = None


def _assigned(match: bytes) -> bool:
    """Whether the value behind the first : or = has six characters."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1 :].lstrip(b" ")
    return len(rest) - rest.startswith((b'"', b"'")) >= 6


@dataclass(frozen=True)
class AtLeast:
    size: int

    def __call__(self, match: bytes) -> bool:
        return len(match) >= self.size


#: The contract's kinds, in its order.
BASE_RULES = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", keep=_assigned),
    Rule("access", r"AKIA[A-Z0-9]+", keep=AtLeast(20)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public token formats that the method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", keep=AtLeast(40)),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", keep=AtLeast(20)),
    Rule("google", r"AIza[A-Za-z0-9_-]+", keep=AtLeast(39)),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", keep=AtLeast(24)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", keep=AtLeast(40)),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
DEFAULT_RULES = BASE_RULES + MORE_RULES


class Scanner:
    """Finds, for each rule, the leftmost-longest non-overlapping matches of a text."""

    def __init__(self, rules: tuple[Rule, ...] = DEFAULT_RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.ignore_case) for r in rules]
        self.marks = compile_rules([reverse(t) for t in trees], search=True)
        self.ends = [compile_rules([t], search=False) for t in trees]
        self.bits = {mask: [i for i in range(len(rules)) if mask >> i & 1] for mask in set(self.marks.rules)}

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, rule number) in code points, by start, then rule number."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found = self._spans(data)
        if found and len(data) != len(text):
            found = _code_points(data, found)
        return found

    def _spans(self, data: bytes) -> list[tuple[int, int, int]]:
        auto = self.marks
        step, accept, state = auto.next, auto.accept, auto.start
        hits = []
        for i, c in enumerate(data.translate(auto.classes)[::-1]):
            state = step[state + c]
            if state >= accept:
                hits.append((i, state))
        if not hits:
            return []
        last, free = len(data) - 1, [0] * len(self.rules)
        found = []
        for i, state in reversed(hits):  # starts ascending
            start = last - i
            for rule in self.bits[auto.rules[state // auto.width]]:
                if start >= free[rule]:
                    free[rule] = end = self._end(rule, data, start)
                    keep = self.rules[rule].keep
                    if keep is None or keep(data[start:end]):
                        found.append((start, end, rule))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _end(self, rule: int, data: bytes, start: int) -> int:
        auto = self.ends[rule]
        step, accept, dead, state, end = auto.next, auto.accept, auto.dead, auto.start, start
        classes, at, size = auto.classes, start, len(data)
        while at < size:
            state = step[state + classes[data[at]]]
            if state == dead:
                break
            at += 1
            if state >= accept:
                end = at
        return end


def _code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points, reading the text once."""
    at, points, place = 0, 0, {}
    for offset in sorted({x for start, end, _ in found for x in (start, end)}):
        points += len(data[at:offset].decode("utf-8", "surrogatepass"))
        at, place[offset] = offset, points
    return [(place[start], place[end], rule) for start, end, rule in found]


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One compilation for each worker process."""
    return Scanner(rules)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """One row (id, spans) for each row of docs; a null or empty text has no spans.

    Reads two columns and shuffles nothing. Repeated ids give repeated rows, an empty table an empty one, and
    other columns, whatever their names, are not read. Memory: one text at a time.
    """
    text_batches(docs.sparkSession)
    import pyarrow as pa

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("spans", SPANS)])
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator) -> Iterator:
        scanner = _scanner(rules)
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": kinds[r]} for s, e, r in scanner.spans(text)] for _, text in rows_of(batch, id_col, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """docs (id, text) with each secret replaced by [kind]; of overlapping spans the earlier one counts."""
    text_batches(docs.sparkSession)
    import pyarrow as pa

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(text_col, T.StringType())])
    kinds = [r.kind for r in rules]

    def redact(batches: Iterator) -> Iterator:
        scanner = _scanner(rules)
        for batch in batches:
            texts = []
            for _, text in rows_of(batch, id_col, text_col):
                at, out = 0, []
                for start, end, rule in scanner.spans(text):
                    if start >= at:
                        out += [text[at:start], f"[{kinds[rule]}]"]
                        at = end
                texts.append(None if text is None else "".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, text_col])

    return docs.select(id_col, text_col).mapInArrow(redact, schema)


def span_text(spans, kinds: list[str] | None = None):
    """kind:start:end, comma-joined in the order of the array; ``kinds`` limits it."""
    if kinds is not None:
        spans = F.filter(spans, lambda x: x["kind"].isin(kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
