"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns give the base spans (e-mail addresses, IP addresses, payment cards, phone numbers); these always
stay. The model looks at islands, the stretches of a text around digits and ``@``; outside of them nothing can
be a span, so an island is decided by itself. In an island, every run of at most ``MOST_TOKENS`` tokens that
could be personal data is a candidate segment for each type; features of the whole span (digits, groups,
separators, check digit, octets, what stands around it) score it, and dynamic programming over the ends of
segments finds the best split of the island into segments and other tokens, boundaries and types at once.

Weights maximise the conditional likelihood of the splits of a bounded sample: of the islands of all documents,
``FIT_ISLANDS`` for each kind of base span and as many without any, of ``FIT_CHARS`` code points at most, chosen by a
hash of the island; with their base spans, the same with the notation varied by rule (no
plus sign, other separators, spelled-out at and dot), and look-alikes that are none (dates, times, amounts).
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import by_slices

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
MOST_CHARS = 96
MOST_DIGITS = 19  # of a number
FIT_ISLANDS = 300  # islands to learn from for each kind of base span in them, and as many without any
FIT_CHARS = 400  # code points of an island that is learned from; longer ones are scored, not learned from
EPOCHS, STEP, DECAY = 12, 0.5, 1e-4

Span = tuple[str, int, int]

# The base patterns, written so that no start is tried twice over the same run of characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    """Check-digit test: from the right, every second digit doubled, digit sums added, a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind as listed, then start; of each kind leftmost and not overlapping."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(map(_octet, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                out.append(("phone", *m.span()))
    return out


_CORE = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[\[(](?:at|AT|dot|DOT)[\])]|[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
_JOIN = re.compile(r"\s{1,3}")


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold a digit or an at sign: whole space-parted chunks, joined over up to three spaces."""
    start = end = -1
    match = _CORE.search(text)
    while match:
        p = match.start()
        left = p
        floor = max(end, p - MOST_CHARS, 0)
        while left > floor and not text[left - 1].isspace():
            left -= 1
        space = _SPACE.search(text, match.end())
        right = space.start() if space else len(text)
        # Spelled-out addresses put spaces around at and dot; take the chunks next to them along.
        if match.group()[0] in "[(" or text[left:right] == "@":
            before = text[:left].rstrip()[-MOST_CHARS:]
            left = max(floor, left - (len(text[:left]) - len(text[:left].rstrip())) - len(before.split()[-1])) if before.split() else left
            more = re.compile(r"(?:\s{0,3}\S{1,64}){0,4}").match(text, right)
            right = more.end() if more else right
        if start >= 0 and (left <= end or _JOIN.fullmatch(text, end, left)):
            end = max(end, right)
        else:
            if start >= 0:
                yield start, end
            start, end = left, right
        match = _CORE.search(text, max(end, match.end()))
    if start >= 0:
        yield start, end


@dataclass
class Segment:
    first: int
    last: int  # token after the segment
    kind: str
    names: list[str]  # features


def _around(c: str) -> str:
    return "none" if not c or c.isspace() else "mark" if c in ",;:!?\"')(" else "other"


def _number_features(span: str, before: str, after: str) -> list[tuple[str, list[str]]]:
    groups = _DIGITS.findall(span)
    digits, seps = "".join(groups), sorted({c for c in span if not c.isdigit() and c not in "+()"})
    sizes = [len(g) for g in groups]
    shape = "".join(seps) or "none"
    common = [f"before={_around(before)}", f"after={_around(after)}", f"seps={shape}", "plus" if span[0] == "+" else "no plus"]
    common.append("parens" if "(" in span else "no parens")
    octets = len(groups) == 4 and shape == "." and all(map(_octet, groups))
    card = 13 <= len(digits) <= 19 and luhn(digits)
    known = "3-3-4" if sizes[-3:] == [3, 3, 4] and len(sizes) <= 4 else "4s" if len(sizes) > 1 and set(sizes[:-1]) == {4} else "one" if len(sizes) == 1 else "mixed"
    common.append(f"groups={known}")
    out = [("ip", [*common, f"octets={octets}", f"n={len(groups)}"])]
    out.append(("card", [*common, f"check={card}", f"long={13 <= len(digits) <= 19}"]))
    out.append(("phone", [*common, f"digits={min(len(digits), 16)}", f"check={card}", f"octets={octets}", f"{known},{'plus' if span[0] == '+' else ''},{shape}"]))
    return out


_MAIL = re.compile(r"([A-Za-z0-9._%+-]+)\s?(@|[\[(](?:at|AT)[\])])\s?([A-Za-z0-9-]+(?:\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?[A-Za-z0-9-]+)*)")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().:/,+-]*[0-9])*")


def segments(text: str, tokens: list[tuple[int, int]]) -> list[Segment]:
    """Candidate segments of a tokenised island, with the features of the whole span."""
    out = []
    for i, (start, _) in enumerate(tokens):
        c = text[start]
        if c.isspace() or (start and (text[start - 1].isalnum() or text[start - 1] in "@_")):
            continue
        if not (c.isalnum() or c in "+("):
            continue
        seen_at, digits = False, 0
        numeric = c.isdigit() or c in "+("
        for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
            end = tokens[j - 1][1]
            if end - start > MOST_CHARS:
                break
            piece = text[tokens[j - 1][0] : end]
            seen_at |= piece == "@" or piece.lower() in ("[at]", "(at)")
            digits += len(piece) if piece[0].isdigit() else 0
            if numeric and digits > MOST_DIGITS and not seen_at:
                numeric = False
            numeric &= piece[0].isdigit() or all(x in " ().:/,+-" for x in piece)
            if not numeric and not seen_at and (piece[0].isspace()):
                if j - i > 2 or not _CORE.match(text, end):
                    break
            after = text[end] if end < len(text) else ""
            if not piece[-1].isalnum() or after.isalnum() or after == "_":
                continue
            span = text[start:end]
            before = text[start - 1] if start else ""
            if seen_at:
                m = _MAIL.fullmatch(span)
                if m:
                    dots = re.split(r"\s?(?:\.|[\[(](?:dot|DOT)[\])])\s?", m[3])
                    names = [f"before={_around(before)}", f"after={_around(after)}", f"at={'plain' if m[2] == '@' else 'spelled'}"]
                    names += [f"dots={min(len(dots), 3) - 1}", f"top={dots[-1].isalpha() and len(dots[-1]) >= 2}", f"spaces={' ' in span}"]
                    out.append(Segment(i, j, "email", names))
            elif numeric and digits >= 4 and _NUMBER.fullmatch(span):
                out += [Segment(i, j, kind, names) for kind, names in _number_features(span, before, after)]
    for s in out:
        s.names = [f"{s.kind}:{x}" for x in ["bias", *s.names]]
    return out


def tokenised(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


@dataclass
class SpanModel:
    weights: dict[str, float] = field(default_factory=dict)

    def _scores(self, found: list[Segment]) -> list[float]:
        w = self.weights
        return [sum(w.get(x, 0.0) for x in s.names) for s in found]

    def best(self, n: int, found: list[Segment]) -> list[Segment]:
        """The split of n tokens with the highest score; tokens outside of segments score nothing."""
        ending: list[list[tuple[Segment, float]]] = [[] for _ in range(n + 1)]
        for s, score in zip(found, self._scores(found), strict=True):
            ending[s.last].append((s, score))
        value, taken = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for s, score in ending[j]:
                if value[s.first] + score > value[j]:
                    value[j], taken[j] = value[s.first] + score, s
        out, j = [], n
        while j:
            s = taken[j]
            if s:
                out.append(s)
            j = s.first if s else j - 1
        return out[::-1]

    def expected(self, n: int, found: list[Segment]) -> list[float]:
        """Probability of each segment, by sums over all splits from the left and from the right."""
        scores = self._scores(found)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        begin: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(found):
            ending[s.last].append(k)
            begin[s.first].append(k)
        left, right = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            left[j] = _log_sum([left[j - 1], *(left[found[k].first] + scores[k] for k in ending[j])])
        for j in range(n - 1, -1, -1):
            right[j] = _log_sum([right[j + 1], *(right[found[k].last] + scores[k] for k in begin[j])])
        return [math.exp(left[s.first] + x + right[s.last] - left[n]) for s, x in zip(found, scores, strict=True)]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """What the model finds beside the base spans, without those that overlap one."""
        out = []
        for start, end in islands(text):
            tokens = tokenised(text, start, end)
            found = segments(text, tokens)
            if not found:
                continue
            for s in self.best(len(tokens), found):
                a, b = tokens[s.first][0], tokens[s.last - 1][1]
                if all(b <= x or y <= a for _, x, y in base):
                    out.append((s.kind, a, b))
        return out


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if len(values) > 1 else top


def _variants(kind: str, span: str) -> list[str]:
    """The same datum in other notations."""
    digits = "".join(_DIGITS.findall(span))
    if kind == "phone" and len(digits) >= 10:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits[:-10] or 1} {a} {b} {c}"]
    if kind == "email" and "@" in span:
        local, domain = span.split("@")
        return [f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local}(at){domain}", f"{local} @ {domain}"]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return []


def _look_alikes(digits: str) -> list[str]:
    """Numbers that are no personal data, made of given digits."""
    d = (digits + "2718281828")[:12]
    year = f"20{d[0:2]}"
    return [f"{year}-0{d[2]}-1{d[3]}", f"1{d[4]}/0{d[5]}/{year}", f"1{d[6]}:3{d[7]}:2{d[8]}", f"{d[:3]},{d[3:6]},{d[6:9]}", f"{year}-{year[:2]}{d[9:11]}", f"{d[0]}.{d[1:3]}.{d[3]}", d[:9], f"{d[:4]} {d[4:8]}", f"{d[:5]}-{d[5:9]}"]


def examples(island: str) -> Iterator[tuple[str, list[Span]]]:
    """Texts with their spans: the island itself, its spans in other notations, and look-alikes."""
    gold = base_spans(island)
    yield island, gold
    for kind, a, b in gold:
        for other in _variants(kind, island[a:b]):
            yield f"{island[:a].strip()} {other}", [(kind, len(island[:a].strip()) + 1, len(island[:a].strip()) + 1 + len(other))]
        for other in _look_alikes("".join(_DIGITS.findall(island[a:b]))):
            yield other, []


def learn(sample: list[str]) -> SpanModel:
    """Weights of highest conditional likelihood by adaptive gradient steps, in a fixed order."""
    data = []
    for island in sample:
        for text, gold in examples(island):
            tokens = [t for start, end in islands(text) for t in tokenised(text, start, end)]
            tokens = tokenised(text, 0, len(text)) if gold else tokens
            found = segments(text, tokens)
            right = {(k, a, b) for k, a, b in gold}
            marks = [float((s.kind, tokens[s.first][0], tokens[s.last - 1][1]) in right) for s in found]
            if found:
                data.append((len(tokens), found, marks))
    model, squares = SpanModel(), {}
    for _ in range(EPOCHS):
        for n, found, marks in data:
            for s, mark, p in zip(found, marks, model.expected(n, found), strict=True):
                if abs(mark - p) < 1e-3:
                    continue
                for x in s.names:
                    g = mark - p - DECAY * model.weights.get(x, 0.0)
                    squares[x] = squares.get(x, 1e-2) + g * g
                    model.weights[x] = model.weights.get(x, 0.0) + STEP * g / math.sqrt(squares[x])
    return model


def sampled_islands(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(kind, h, island): of all islands of all documents, for each kind (and for none) those of the lowest hashes.

    An island counts for every kind that it has a base span of, so rare kinds are learned wherever they occur. A
    task keeps FIT_ISLANDS of each kind, so nothing grows with the documents.
    """

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {k: {} for k in (*KINDS, "none")}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for a, b in islands(t):
                    if b - a <= FIT_CHARS:
                        island = t[max(0, a - 12) : b]
                        for kind in {k for k, _, _ in base_spans(island)} or {"none"}:
                            held[kind][island] = xxhash.xxh64_intdigest(island.encode("utf-8", "replace")) >> 1
            for kind, own in held.items():
                if len(own) > FIT_ISLANDS:
                    held[kind] = dict(heapq.nsmallest(FIT_ISLANDS, own.items(), key=lambda x: (x[1], x[0])))
        rows = [(kind, h, island) for kind, own in held.items() for island, h in own.items()]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["kind", "h", "island"])

    rows = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("__text")).mapInArrow(lowest, "kind string, h bigint, island string")
    ranked = rows.distinct().withColumn("__r", F.row_number().over(Window.partitionBy("kind").orderBy("h", "island")))
    return ranked.where(F.col("__r") <= FIT_ISLANDS).drop("__r")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> SpanModel:
    """Model from a sample of the islands of all documents (``sampled_islands``); without islands it adds nothing."""
    taken = {r["island"]: r["h"] for r in sampled_islands(docs, key, text).collect()}  # five times FIT_ISLANDS at most
    return learn(sorted(taken, key=lambda x: (taken[x], x)))


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def all_spans(model: SpanModel, text: str) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    found = [(*s, True) for s in base] + [(*s, False) for s in model.spans(text, base)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def personal_spans(model: SpanModel, text: Column) -> Column:
    """Spans of a text by kind, then start, in code points; none for a null or an empty text."""

    @F.arrow_udf(SPANS)
    def found(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        names = ("kind", "start", "end", "base")

        def work(part: pa.Array) -> pa.Array:
            return pa.array([[dict(zip(names, s, strict=True)) for s in all_spans(model, t)] if t else [] for t in part.to_pylist()], kind)

        return by_slices(column, work, kind)

    return found(text)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at, end = [], 0, -1
    for a, b, kind in sorted(spans):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def redacted(model: SpanModel, text: Column) -> Column:
    """The text with all its personal data replaced; a null text stays null."""

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        def work(part: pa.Array) -> pa.Array:
            return pa.array([t and masked(t, [(a, b, k) for k, a, b, _ in all_spans(model, t)]) for t in part.to_pylist()], pa.string())

        return by_slices(column, work, pa.string())

    return clean(text)


def with_personal_data(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with ``personal``, the spans of each text; one row each, in one pass without a shuffle.

    Null and empty texts have no spans; repeated rows get equal ones; an empty table stays empty. A column of this
    name is replaced. Very long texts take time in proportion to their length.
    """
    return docs.withColumn("personal", personal_spans(model, F.col(text)))
