"""Personal data: patterns, and candidates beyond them that boosted trees judge.

Four kinds have patterns whose matches are always reported (base). Generators with a high recall propose further
spans, which may overlap: addresses written out with "at" and "dot", longer internet addresses, numbers with other
separators or without a country code, each whole and in pieces. Gradient-boosted trees see the format of a proposal
and the words next to it; of what reaches the kind's calibrated threshold, the best that don't overlap are reported.
"""

from __future__ import annotations

import bisect
import dataclasses
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotmark.llm import common

KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]
)
#: Made-up texts that a model is fitted on, and the share of a kind's reports that should be right where it is calibrated.
LABELLED, PRECISION = 6000, 0.98
TREES, DEPTH = 30, 5
#: Characters before and after a proposal in which words count.
NEAR = 40

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Stretches that hold all of an internet address or card number. Patterns are run in them alone.
STRETCH = re.compile(r"[0-9][0-9. -]*")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,3}[0-9])+")
LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|:){2,8}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
AT = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT|@) ")
BEHIND = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]{1,63}){1,6}")
NEAR_KIND = {
    "email": re.compile(r"mail|contact|write|reach|address|correo"),
    "ip": re.compile(r"\bip\b|ipv6|host|server|address|ping|connect|client|peer"),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta"),
    "phone": re.compile(r"phone|\btel|call|mobile|cell|fax|whatsapp|reach|number|handy|dial|sms"),
}
NEAR_OTHER = re.compile(r"order|invoice|isbn|issn|version|serial|ticket|build|price|total|\bid\b|\bno\b|population|date|year|room|page|mac\b|time|hash|reference|tracking|article")
#: Endings that tell a mail address from prose, as fixed values.
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk it nl ch at eu us ca au jp cn br co ru se no".split())
FEATURES = [
    "email", "ip", "card", "phone", "length", "digits", "letters", "marks", "mark_kinds", "groups", "longest", "shortest", "last", "luhn", "plus", "zero", "paren", "first",
    "bracket", "ending", "date", "fours", "local", "near_kind", "near_other", "near_after", "left", "right", "inner",
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match begins where the run of local characters before its @ does, so only these runs are looked at."""
    done = 0
    for tail in TAIL.finditer(text):
        at = tail.start()
        start = done + len(text[done:at].rstrip(LOCAL))
        if start < at:
            yield start, tail.end()
        done = tail.end() if start < at else at + 1


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns match, in order; kinds are places in KINDS."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for part in STRETCH.finditer(text):
        if part.end() - part.start() < 7:
            continue
        for m in IP.finditer(text, *part.span()):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, *part.span()):
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end): spans that may be personal data, overlapping ones among them."""
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b - a < 7:
            continue
        cuts = [(a, b)]
        if " " in m[0]:
            edges = [a, *(a + s.start() for s in re.finditer(" +", m[0])), b]
            cuts += [(x + len(text[x:y]) - len(text[x:y].lstrip(" )/.-")), y) for x, y in zip(edges, edges[1:], strict=False) if y - x >= 7 and y - x < b - a]
        for x, y in cuts:
            n = sum("0" <= c <= "9" for c in text[x:y]) if y - x <= 60 else 0
            if 7 <= n <= 15:
                yield x, 3, y
            if 13 <= n <= 19:
                yield x, 2, y
    if text.count(":") > 1:
        for m in LONG_IP.finditer(text):
            yield m.start(), 1, m.end()
    for m in AT.finditer(text):
        left = text[max(0, m.start() - 64) : m.start()]
        start = m.start() - len(left) + len(left.rstrip(LOCAL))
        tail = BEHIND.match(text, m.end())
        if start < m.start() and tail:
            yield start, 0, tail.end()


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """The values of FEATURES for a proposal."""
    s = text[start:end]
    digits, groups = _digits(s), [len(g) for g in re.findall("[0-9A-Za-z]+", s)]
    marks = re.sub("[0-9A-Za-z]", "", s)
    before, after = text[max(0, start - NEAR) : start].lower(), text[end : end + NEAR].lower()
    left, right = text[start - 1 : start], text[end : end + 1]
    ending = re.search("[A-Za-z]*$", s)[0].lower()
    date = re.fullmatch(r"(?:(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]|[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2}|(?:1[0-9]|20)[0-9]{2}[ /-]+(?:1[0-9]|20)[0-9]{2}|(?:19|20)[0-9]{2}[01][0-9][0-3][0-9])", s)
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), sum(c.isalpha() for c in s), len(marks), len(set(marks)), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        float(kind == 2 and luhn(digits)), float(s.startswith(("+", "00"))), float(digits.startswith("0")), float("(" in s), float(digits[0]) if digits else -1.0,
        float(bool(re.search(r"[\[({<] ?(?:at|AT|@|dot|DOT)", s))), float(ending in ENDINGS), float(bool(date)), float(groups[:-1].count(4) >= 2), float(bool(re.match("[A-Za-z0-9]*[0-9._%+-]", s)) if kind == 0 else 0),
        float(bool(NEAR_KIND[KINDS[kind]].search(before))), float(bool(NEAR_OTHER.search(before))), float(bool(NEAR_OTHER.search(after[:12]))),
        float(left.isalnum()) + 2 * (left in ("-", "_", "/", ".", "#", "$", "=") and left != ""), float(right.isalnum()) + 2 * (right in ("-", "_", "/", "%", ":") and right != ""), float("::" in s or "  " in s),
    ]


@dataclasses.dataclass
class Model:
    """The trees of a fitted classifier as flat arrays: of a node its feature (-1: a leaf), the bound up to which rows go left,
    its children, its value; and of a kind the score from which a span is reported."""

    roots: list[int]
    weights: list[float]
    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    thresholds: dict[str, float]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The probability that each row's span is personal data, before calibration."""
        total = np.zeros(len(rows))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(rows), root)
            while True:
                inner = np.flatnonzero(self.feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(rows[inner, self.feature[node]] <= self.bound[node], self.left[node], self.right[node])
            total += weight * self.value[at]
        return 1 / (1 + np.exp(-2 * total))


def flattened(trees: list[str], weights: list[float]) -> Model:
    """A model of the trees that Spark describes: lines of `If (feature 3 <= 0.5)`, `Else (...)`, `Predict: 0.1`, each nested by a space."""
    nodes: list[list[float]] = []

    def grown(lines: Iterator[str]) -> int:
        line, place = next(lines), len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        if said := re.fullmatch(r"\s*If \(feature (\d+) <= (.*)\)", line):
            left = grown(lines)
            next(lines)  # the Else
            nodes[place] = [int(said[1]), float(said[2]), left, grown(lines), 0.0]
        else:
            nodes[place][4] = float(line.rpartition("Predict: ")[2])
        return place

    roots = [grown(iter(tree.rstrip().split("\n")[1:])) for tree in trees]
    feature, bound, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Model(roots, weights, feature.astype(int), bound, left.astype(int), right.astype(int), value, dict.fromkeys(KINDS, 0.5))


def calibrated(scores: np.ndarray, labels: np.ndarray, precision: float) -> float:
    """The least score from which a span is personal data with at least this probability, by isotonic regression of the labels on
    the scores (pools of neighbours that break the order). 1.0, which no span reaches, if there is none."""
    pools: list[list[float]] = []
    for i in np.argsort(scores, kind="stable"):
        pools.append([scores[i], float(labels[i]), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, total, n = pools.pop()
            pools[-1][1] += total
            pools[-1][2] += n
    return float(min((low for low, total, n in pools if total >= precision * n), default=1.0))


def labelled_texts(n: int = LABELLED, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up texts, each with its spans of personal data (start, kind, end) that no pattern matches: one, two numbers of
    cards beside each other, or none but something like it: numbers of orders and books, dates, amounts, versions,
    hardware addresses, prose with "at"."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ou", "tre", "en", "pa", "la", "the", "ly", "st", "ver", "ung", "ach", "in", "and")) for _ in range(r.randint(1, 3)))
    prose = lambda k: " ".join(word() for _ in range(k))
    number = lambda form: re.sub("9", lambda _: r.choice("0123456789"), re.sub("8", lambda _: r.choice("23456789"), form))
    host = lambda: f"{word()}{r.choice(('', r.choice('0123456789')))}"

    def checked(size: int, good: bool) -> str:
        body = r.choice(("4", "51", "55", "34", "37", "6011", "30"))
        body += number("9" * (size - len(body) - 1))
        right = next(d for d in "0123456789" if luhn(body + d))
        return body + (right if good else r.choice([d for d in "0123456789" if d != right]))

    def spaced(digits: str, mark: str) -> str:
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    def longer() -> str:
        groups = [format(r.randrange(1, 1 << 16), "x") for _ in range(r.choice((8, 8, 4, 5)))]
        return ":".join(groups) if len(groups) == 8 else ":".join(groups[:-1]) + "::" + groups[-1]

    at, dot = lambda: r.choice((" at ", " [at] ", "(at)", "[at]", " (at) ", " AT ")), lambda: r.choice((" dot ", "[dot]", " [dot] ", "(dot)", "."))
    said = {
        "phone": ("phone: ", "call ", "tel. ", "Tel: ", "mobile ", "fax ", "my number is ", "you can reach me on ", "dial ", ""),
        "card": ("card ", "credit card: ", "visa ", "paid by card no. ", "debit card ", "payment with ", ""),
        "ip": ("host ", "server ", "ip ", "address ", "ping ", "connect to ", ""),
        "email": ("mail ", "contact ", "write to ", "e-mail: ", "reach me: ", ""),
    }
    other = ("order ", "invoice no ", "isbn ", "version ", "serial ", "ticket ", "build ", "price ", "total ", "id ", "reference ", "tracking ", "population ", "", "", "in ", "and ", "page ")

    def one() -> tuple[str, str, int]:
        """What stands before the span, the span and its kind."""
        kind = r.randrange(4)
        lead = r.choice(said[KINDS[kind]])
        if r.random() < 0.5:
            if kind == 3:
                form = r.choice(("(899) 899-9999", "899-899-9999", "899.899.9999", "899 899 9999", "0899 8999999", "00 89 899 999999", "8999999999", "099 89999999", "899-9999", "(099) 8999 9999", "0899/8999999"))
                return lead or r.choice(("call ", "phone ")), number(form), kind
            if kind == 2:
                size = r.choice((13, 14, 15, 16, 16, 16, 19))
                digits = checked(size, True)
                if r.random() < 0.25:  # the pattern for cards takes both numbers for one
                    return lead, f"{checked(16, True)} {r.choice((checked(16, True), checked(16, False), number('99'), number('999')))}", 4
                return lead, (digits if size == 13 and r.random() < 0.6 else spaced(digits, r.choice((".", "/", " - ", "  ", " -", "--")))), kind
            if kind == 1:
                return lead, longer(), kind
            return lead, f"{host()}{r.choice(('', '.', '_'))}{word()}{at()}{host()}{dot()}{r.choice(sorted(ENDINGS))}", kind
        if kind == 2:
            # a number that fails its check is none of a card, whatever stands before it
            return r.choice((lead, r.choice(other))), r.choice((checked(16, False), spaced(checked(16, False), r.choice((".", " ", "-", "/", " - "))), checked(r.choice((13, 14, 15, 19)), False))), -1
        if kind == 3:
            form = r.choice(
                ("1999-08-09", "0999-8-9", "09.08.1999", "2009-2014", "20090812", "8 999 999", "8.999.999", "899999999", "8999999", "999-8-99-999999-9", "8.99.999.9", "99999-9999", "89-99-99-99-99", "2019 8999 99", "0.9999999", "899999.99 ", "9999999999", "4/8/1999 09")
            )
            return r.choice(other), number(form).strip(), -1
        if kind == 1:
            form = r.choice(("09:39:59", "99:A9:9B:C9:9D:E9", "9:8:9", "1999:09:09", "99:99:9f", "9:9:9:9"))
            return r.choice((*other, "mac ", "time ", "ip ", "at ")), number(form), -1
        return r.choice(("look", "meet", "we", "sold", "stay", "only")), f" at {word()}{r.choice(('.', '.', ' '))}{r.choice((word(), 'com', 'home', 'the', word().capitalize()))}", -1

    out = []
    for _ in range(n):
        lead, span, kind = one()
        head = f"{prose(r.randint(0, 9))} {lead}".lstrip()
        tail = r.choice((" ", ". ", ", ", "\n", "; ", "")) + prose(r.randint(0, 6)) if r.random() < 0.8 else ""
        if kind < 0 and r.random() < 0.15:  # inside of a word
            head, tail = head + r.choice("abcxyz_#"), r.choice("abcxyz%") + tail
        tail = tail if not tail or not tail[0].isalnum() or kind < 0 else f" {tail}"
        parts = [(m.start(), m.end()) for m in re.finditer("[0-9]+", span) if luhn(m[0]) and len(m[0]) == 16] if kind == 4 else [(0, len(span))]
        out.append((head + span + tail, [(len(head) + a, 2 if kind == 4 else kind, len(head) + b) for a, b in parts if kind >= 0]))
    return out


def beyond(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The proposals that overlap nothing of `known`, which is in order."""
    free, ends, reach = [], [], 0
    for _, _, b in known:
        reach = max(reach, b)
        ends.append(reach)
    starts = [a for a, _, _ in known]
    for a, kind, b in sorted(set(proposals(text))):
        place = bisect.bisect_left(starts, b)
        if not place or ends[place - 1] <= a:
            free.append((a, kind, b))
    return free


def train(spark: SparkSession, labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None, seed: int = 7, precision: float = PRECISION) -> Model:
    """Trees boosted on two thirds of the labelled texts' proposals, and thresholds calibrated on the last third.

    A proposal is right if it has the kind, the start and the end of one of its text's spans; the others, those that overlap one
    among them, are wrong. labelled: (text, spans) as of labelled_texts(), a bounded sample that the driver holds.
    """
    rows = []
    for i, (text, right) in enumerate(labelled_texts() if labelled is None else labelled):
        rows += [(i % 3, k, float((a, k, b) in right), [float(x) for x in features(text, a, k, b)]) for a, k, b in beyond(text, base(text))]
    made = spark.createDataFrame([(y, x) for fold, _, y, x in rows if fold], "label double, xs array<double>").select("label", array_to_vector("xs").alias("features")).coalesce(1).persist()
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, minInstancesPerNode=5, subsamplingRate=0.8).fit(made)
    made.unpersist()
    model = flattened([t.toDebugString for t in fitted.trees], fitted.treeWeights)
    held = [(k, y, x) for fold, k, y, x in rows if not fold]
    scores = model.scores(np.array([x for _, _, x in held]))
    kinds, labels = np.array([k for k, _, _ in held]), np.array([y for _, y, _ in held])
    model.thresholds = {name: calibrated(scores[kinds == k], labels[kinds == k], precision) for k, name in enumerate(KINDS)}
    return model


def spans(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """The spans of a text: (kind, start, end, base, score), by start, kind and end. Base ones have the score 1."""
    known = base(text)
    maybe = beyond(text, known)
    found = [(a, kind, b, True, 1.0) for a, kind, b in known]
    if maybe:
        scores = model.scores(np.array([features(text, *p) for p in maybe]))
        good = [(-s, a - b, a, kind, b) for s, (a, kind, b) in zip(scores.tolist(), maybe, strict=True) if s >= model.thresholds[KINDS[kind]]]
        starts: list[int] = []
        ends: list[int] = []
        for s, _, a, kind, b in sorted(good):
            place = bisect.bisect_left(starts, b)
            if not place or ends[place - 1] <= a:
                starts.insert(place, a)
                ends.insert(place, b)
                found.append((a, kind, b, False, -s))
    return [(KINDS[kind], a, b, known_, s) for a, kind, b, known_, s in sorted(found)]


def masked(text: str, found: list[tuple[str, int, int, bool, float]]) -> str:
    """The text with each span, or run of spans that overlap, as the first one's kind in brackets."""
    out, done = [], 0
    for kind, a, b, _, _ in found:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text", redacted: str | None = None) -> DataFrame:
    """One row per row of docs: the columns `keep` (all but the text, if None) and `spans`, an array of (kind, start, end, base, score)
    with code points counted from 0 and the end exclusive; with `redacted`, a column of that name has the text with its
    spans masked.

    Whole texts are searched; a null text counts as empty, and its redacted text is null. Equal rows give equal rows; a column that is named `spans` in any case
    is replaced. An empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c.lower() not in (text.lower(), "spans")] if keep is None else keep
    body = common.free("_text", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(body))
    fields = [*source.drop(body).schema.fields, T.StructField("spans", T.ArrayType(SPAN)), *([T.StructField(redacted, T.StringType())] if redacted else [])]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in fields]
        for batch in batches:
            for part in common.chunks(batch, body):
                texts = part.column(part.schema.get_field_index(body)).to_pylist()
                found = [spans(t or "", model) for t in texts]
                columns = [part.column(i) for i in range(len(keep))]
                columns.append(pa.array([[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in f] for f in found], kind))
                if redacted:
                    columns.append(pa.array([t if t is None else masked(t, f) for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    common.small_batches(docs.sparkSession)
    return source.mapInArrow(run, T.StructType(fields))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
