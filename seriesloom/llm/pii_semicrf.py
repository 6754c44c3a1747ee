"""Personal data: fixed detectors, and a semi-Markov conditional random field that adds the spans they miss."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import whole

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# ---- base detectors ------------------------------------------------------------------------------------------
# The patterns of the four kinds. A lookbehind keeps digit runs from being tried again at each digit.

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(d) if k % 2 == 0 else int(doubled[int(d)]) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ in turn: the longest local part after the last match, then a domain."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else free
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed; kinds may overlap each other."""
    found = [(a, b, 0) for a, b in _emails(text)]
    if _DIGITS.search(text):
        found += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# ---- zones and whole-span features ---------------------------------------------------------------------------

_REST = re.compile(r"\S*")
_MARK = re.compile("[0-9@]")
_PIECE = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
#: Longest entity, in pieces (digit runs, letter runs, single signs). It bounds the segments at each position.
LONGEST = 24
FEATURES = 24


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words that hold a digit or @, joined over single spaces. Outside them no segment can be an entity."""
    start = end = -1
    mark = _MARK.search(text)
    while mark:
        first, free = mark.start(), max(end, 0)
        while first > free and not text[first - 1].isspace():
            first -= 1
        last = _REST.match(text, mark.end()).end()
        if start >= 0 and not (first == end + 1 and text[end] == " "):
            yield start, end
            start = -1
        start, end = first if start < 0 else start, last
        mark = _MARK.search(text, end)
    if start >= 0:
        yield start, end


_ONLY = {"email": re.compile(r"[A-Za-z0-9._%+@-]+"), "ip": re.compile("[0-9.]+"), "card": re.compile(r"[0-9 .-]+"), "phone": re.compile(r"\+?[0-9 ().-]+")}
_GROUPED = re.compile(r"\+?(?:[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}")


def span_features(text: str, left: str, right: str) -> np.ndarray:
    """Properties of a whole candidate segment and the letters beside it."""
    digits = _digits(text)
    groups = re.findall("[0-9]+", text)
    n, ats = len(digits), text.count("@")
    only = {k: p.fullmatch(text) is not None for k, p in _ONLY.items()}
    local, _, domain = text.partition("@")
    values = (
        1.0, ats == 1, ats == 1 and only["email"], bool(local) and "." in domain.strip(".") and ats == 1, only["ip"], only["ip"] and len(groups) == 4,
        len(groups) == 4 and text.count(".") == 3 and all(map(_small, groups)), any(len(g) > 3 for g in groups), only["card"],
        only["card"] and 12 <= n <= 19, only["card"] and 12 <= n <= 19 and luhn(digits), text.startswith("+"), only["phone"],
        only["phone"] and text.startswith("+") and 9 <= n <= 15, _GROUPED.fullmatch(text) is not None, n < 9, n > 19,
        any(c.isalpha() for c in text), left.isalnum() or left in "+@._%-", right.isalnum() or right in "@_%", text[:1].isspace() or text[-1:].isspace(),
        not (text[-1:].isalnum()), len(groups) == 1, not (text[:1].isalnum() or text[:1] in "+("),
    )
    return np.array(values, np.float64)


@dataclass
class Lattice:
    """Pieces of one zone and the features of every candidate segment: `rows[(i, j)]` is a row of `features`."""

    text: str
    cuts: list[int]
    rows: dict[tuple[int, int], int]
    features: np.ndarray

    @classmethod
    def of(cls, text: str, before: str = " ", after: str = " ") -> Lattice:
        cuts = [m.start() for m in _PIECE.finditer(text)] + [len(text)]
        rows, table = {}, []
        for i in range(len(cuts) - 1):
            if not (text[cuts[i]].isalnum() or text[cuts[i]] in "+("):
                continue
            for j in range(i + 1, min(i + LONGEST, len(cuts) - 1) + 1):
                part = text[cuts[i]:cuts[j]]
                if part[-1].isalnum() and _MARK.search(part):
                    left = text[cuts[i] - 1] if cuts[i] else before
                    right = text[cuts[j]] if cuts[j] < len(text) else after
                    rows[i, j] = len(table)
                    table.append(span_features(part, left, right))
        return cls(text, cuts, rows, np.array(table) if table else np.zeros((0, FEATURES)))


# ---- the model -----------------------------------------------------------------------------------------------


class SemiCRF:
    """Segments of one piece are outside; longer or marked ones may be an entity of a kind.

    The score of a segmentation is the sum of weights times span features of its entities and of a weight for each
    adjacent pair of labels (outside first). Decoding and training sum over all segmentations whose entities have at
    most LONGEST pieces.
    """

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        k = len(KINDS)
        self.weights = np.zeros((k, FEATURES)) if weights is None else weights
        self.moves = np.zeros((k + 1, k + 1)) if moves is None else moves

    def _ending(self, lattice: Lattice) -> list[list[tuple[int, int]]]:
        ending: list[list[tuple[int, int]]] = [[] for _ in lattice.cuts]
        for (i, j), row in lattice.rows.items():
            ending[j].append((i, row))
        return ending

    def decode(self, lattice: Lattice) -> list[tuple[int, int, str, float]]:
        """Best segmentation's entities: start, end, kind and the segment's own score against outside."""
        n, k = len(lattice.cuts) - 1, len(KINDS)
        score = lattice.features @ self.weights.T
        best = np.full((n + 1, k + 1), -np.inf)
        back: list[list[tuple[int, int, int] | None]] = [[None] * (k + 1) for _ in range(n + 1)]
        best[0, 0] = 0.0
        ending = self._ending(lattice)
        for j in range(1, n + 1):
            into = best[j - 1] + self.moves[:, 0]
            best[j, 0], back[j][0] = into.max(), (j - 1, int(into.argmax()), -1)
            for i, row in ending[j]:
                into = best[i][:, None] + self.moves[:, 1:]
                top = into.max(axis=0) + score[row]
                for y in np.flatnonzero(top > best[j, 1:]):
                    best[j, y + 1], back[j][y + 1] = top[y], (i, int(into[:, y].argmax()), row)
        out, at, y = [], n, int(best[n].argmax())
        while at:
            i, was, row = back[at][y]
            if row >= 0:
                out.append((lattice.cuts[i], lattice.cuts[at], KINDS[y - 1], float(score[row, y - 1])))
            at, y = i, was
        return out[::-1]

    def gradient(self, lattice: Lattice, gold: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Observed minus expected features and label moves; gold: (first piece, last piece, label)."""
        n, k = len(lattice.cuts) - 1, len(KINDS)
        score = lattice.features @ self.weights.T
        ending = self._ending(lattice)
        forward = np.full((n + 1, k + 1), -np.inf)
        forward[0, 0] = 0.0
        total = lambda x: np.logaddexp.reduce(x, axis=0)
        for j in range(1, n + 1):
            forward[j, 0] = total(forward[j - 1] + self.moves[:, 0])
            for i, row in ending[j]:
                forward[j, 1:] = np.logaddexp(forward[j, 1:], total(forward[i][:, None] + self.moves[:, 1:]) + score[row])
        backward = np.full((n + 1, k + 1), -np.inf)
        backward[n] = 0.0
        starting: list[list[tuple[int, int]]] = [[] for _ in lattice.cuts]
        for (i, j), row in lattice.rows.items():
            starting[i].append((j, row))
        for i in range(n - 1, -1, -1):
            backward[i] = self.moves[:, 0] + backward[i + 1, 0]
            for j, row in starting[i]:
                backward[i] = np.logaddexp(backward[i], np.logaddexp.reduce(self.moves[:, 1:] + score[row] + backward[j, 1:], axis=1))
        z = total(forward[n])
        seen = np.zeros((len(lattice.features), k))
        step = np.zeros_like(self.moves)
        for j in range(1, n + 1):
            step[:, 0] -= np.exp(forward[j - 1] + self.moves[:, 0] + backward[j, 0] - z)
            for i, row in ending[j]:
                mass = np.exp(forward[i][:, None] + self.moves[:, 1:] + score[row] + backward[j, 1:] - z)
                step[:, 1:] -= mass
                seen[row] -= mass.sum(axis=0)
        was, at = 0, 0
        for i, j, y in [*gold, (n, n, -1)]:
            while at < i:
                step[was, 0] += 1
                was, at = 0, at + 1
            if y > 0:
                step[was, y] += 1
                seen[lattice.rows[i, j], y - 1] += 1
                was, at = y, j
        return seen.T @ lattice.features, step

    def fit(self, examples: list[tuple[Lattice, list[tuple[int, int, int]]]], rounds: int = 40, rate: float = 0.3, ridge: float = 0.002) -> SemiCRF:
        """Likelihood ascent with per-weight step sizes, in a fixed order: the same examples give the same model."""
        sums = [np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)]
        for _ in range(rounds):
            steps = [np.zeros_like(self.weights), np.zeros_like(self.moves)]
            for lattice, gold in examples:
                for held, part in zip(steps, self.gradient(lattice, gold)):
                    held += part / len(examples)
            for values, part, spread in zip((self.weights, self.moves), steps, sums):
                part -= ridge * values
                spread += part * part
                values += rate * part / np.sqrt(spread)
        return self


# ---- training on silver labels -------------------------------------------------------------------------------


def _example(text: str, spans: Sequence[Span]) -> tuple[Lattice, list[tuple[int, int, int]]] | None:
    lattice = Lattice.of(text)
    at = {c: k for k, c in enumerate(lattice.cuts)}
    gold, free = [], 0
    for a, b, kind in sorted(spans):
        if a < free:
            continue
        if a not in at or b not in at or (at[a], at[b]) not in lattice.rows:
            return None
        gold.append((at[a], at[b], 1 + KINDS.index(kind)))
        free = b
    return lattice, gold


def _variants(text: str, spans: Sequence[Span]) -> Iterator[tuple[str, list[Span]]]:
    """Forms of a found span that the patterns miss: a phone without plus, a card in dotted groups, and near misses."""
    for a, b, kind in spans:
        part = text[a:b]
        if kind == "phone":
            digits = _digits(part)[-10:]
            local = f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
            yield local, [(0, len(local), kind)]
        if kind == "card":
            digits = _digits(part)
            dotted = ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
            yield dotted, [(0, len(dotted), kind)]
            broken = digits[:-1] + str((int(digits[-1]) + 5) % 10)
            yield broken, []
        if kind == "ip":
            yield part.rsplit(".", 1)[0], []
            yield part + ".999", base_spans(part + ".999")
        if kind == "email":
            yield part.replace("@", "", 1), []


#: Fixed negatives: numbers that are no personal data.
NEGATIVES = ("1999", "2024-05-17", "3.14159", "v2.0.1", "100,000", "1/2", "10:45", "4.0.", "555", "12-34", "1000000000", "A4", "40%", "@home", "300.400.500.600")


def marked(text: Column) -> Column:
    """Whether a text has a digit or @: no other has zones or spans."""
    return text.rlike("[0-9@]")


def train(docs: DataFrame, text: str = "text", sample_docs: int = 300, examples: int = 120) -> SemiCRF:
    """Fit on zones of a bounded hash sample: at most `sample_docs` documents that have digits or @, eight short zones
    each, `examples` zones in all, labelled by the base detectors, with variants of the spans found and fixed negatives."""
    near = F.regexp_extract_all("text", F.lit(r"(?:[^\s]{0,40}[0-9@][^\s]{0,40}\x20?){1,8}"), F.lit(0))
    hashed = docs.where(marked(whole(text))).select(F.xxhash64(whole(text)).alias("order"), whole(text).alias("text"))
    # The sample's last hash is found first: zones are cut from its texts only, and no others leave their tasks.
    last = hashed.select("order").orderBy("order").limit(sample_docs).agg(F.max("order")).first()[0]
    rows = (hashed.where(F.col("order") <= F.lit(last).cast("bigint")).select("order", F.slice(near, 1, 8).alias("zones"))
            .orderBy("order").limit(sample_docs).collect())
    found: list = []
    counts = dict.fromkeys((*KINDS, ""), 0)
    for row in rows:
        for zone in map(str.strip, row["zones"]):
            spans = base_spans(zone)
            kind = spans[0][2] if spans else ""
            if counts[kind] >= examples // 5:
                continue
            counts[kind] += 1
            for part, gold in [(zone, spans), *_variants(zone, spans)]:
                made = _example(part, gold)
                if made:
                    found.append(made)
    found += [made for made in (_example(x, []) for x in NEGATIVES) if made]
    return SemiCRF().fit(found)


# ---- the distributed job -------------------------------------------------------------------------------------


def added_spans(model: SemiCRF, text: str, base: Sequence[Span], margin: float) -> list[Span]:
    """Entities of the best segmentation that touch no base span and score at least `margin` above outside."""
    out = []
    taken = sorted((a, b) for a, b, _ in base)
    for start, end in zones(text):
        inside = [(a, b) for a, b in taken if a < end and start < b]
        if sum(b - a for a, b in inside) >= end - start - 1 - len(inside):
            continue  # the base spans fill the zone
        lattice = Lattice.of(text[start:end], text[start - 1] if start else " ", text[end] if end < len(text) else " ")
        for a, b, kind, score in model.decode(lattice):
            a, b = a + start, b + start
            if score >= margin and not any(x < b and a < y for x, y in inside):
                out.append((a, b, kind))
    return out


def joined(spans: Sequence[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]])))


def personal_data(docs: DataFrame, model: SemiCRF | None = None, margin: float = 2.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (kind:start:end list), spans (base and added), and the number of base spans of each kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows are read each; an empty
    table gives no rows. The model is a few hundred numbers. Texts without a digit or @ have no spans and are not sent to
    Python, only their rows are.
    """
    model = model or train(docs, text)
    weights, moves = model.weights, model.moves
    base = docs.select(F.col(doc_id).alias("doc_id"), F.when(marked(whole(text)), whole(text)).otherwise("").alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SemiCRF(weights, moves)
        for batch in batches:
            fixed, every, counts = [], [], {k: [] for k in KINDS}
            for value in batch.column("text").to_pylist():
                spans = base_spans(value)
                fixed.append(joined(spans))
                every.append(joined([*spans, *added_spans(crf, value, spans, margin)]))
                for k in KINDS:
                    counts[k].append(sum(x == k for _, _, x in spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(fixed, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    return base.mapInArrow(find, f"doc_id {kind}, " + "".join(f"n_{k} bigint, " for k in KINDS) + "base string, spans string")
