"""Personal data: exact base patterns, and further spans that boosted trees select among generous candidates.

Base spans follow fixed patterns and checks. Candidate generators propose many
more spans that may overlap. For each kind, trees learn from all candidates how
base spans look and what stands around them (not the marks that the base pattern
itself asks for, such as a phone number's plus sign and country code), against
candidates that cannot be of the kind: those that fail a wider format check, stand
among other numbers or overlap another kind's base span, and a few fixed ones.
Other lookalikes off the base spans are never taught as negatives; one is added
where its calibrated probability of being of the kind reaches a threshold chosen
for precision on candidates not learned from.
"""

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.boosting import Forest, binned, edges_of, fit_forests, thresholds
from tipoff.llm.labelled import lowest
from tipoff.operators.moments import vectors
from tipoff.session import materialize, materialize_counted

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
LEAST = 0.9  # lowest calibrated probability of an added span
AROUND = 24  # characters of context to either side
LONGEST = 80  # characters of a candidate; longer ones are no single datum

# The base patterns, in forms that never go back over long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MAYBE = {
    "email": re.compile(r"[\w.%+-]{1,64}(?: ?@ ?| ?[\[(]at[\])] ?)[\w-]{1,40}(?:(?: ?[.,] ?| ?[\[(]dot[\])] ?)[\w-]{2,20}){1,3}"),
    "ip": re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?: ?[.,:_-] ?[0-9]{1,4}){3}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){12,21}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+|\(|00)?[0-9](?:[ ().\-/]{0,3}[0-9]){6,16}(?![0-9A-Za-z])"),
}
_HINTS = {
    "email": "mail contact kontakt write correo courriel @ send".split(),
    "ip": "ip server host address adresse login from".split(),
    "card": "card visa pay credit karte tarjeta carte number".split(),
    "phone": "tel phone call fax mobile fon teléfono anruf appel".split(),
}
N_FEATURES = 18
_LEARNABLE = "kind int, y int, mark long, held boolean, x array<float>"
_HINTED = {k: re.compile(rf"(?:@|\b(?:{'|'.join(h for h in v if h != '@')}))", re.I) for k, v in _HINTS.items()}
# What a candidate is to the trees: a base span, a sure negative, neither, or one that may be added.
BASE, NOT, LEFT, OPEN = 1, 0, 2, 3

_AT, _DOT = re.compile(r" ?[\[(]at[\])] ?| ?@ ?"), re.compile(r" ?[\[(]dot[\])] ?| ?\. ?")
_MAIL = re.compile(r"[\w.%+-]*[^\W\d_][\w.%+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,20}")
_DATE = re.compile(r"(?<![\d./-])(?:\d{1,2}([./-])\d{1,2}\1(?:\d{4}|\d{2})|\d{4}([./-])\d{1,2}\2\d{1,2})(?!\d|[./-]\d)")
_AMOUNT = re.compile(r"\d+\.\d+|\d{1,3}(?:([ .])\d{3})(?:\1\d{3})+|(?:1\d|20)\d\d ?[-/] ?(?:1\d|20)\d\d")
_COUNTRY = re.compile(r"[0-9]{1,3}[^0-9]+(?=[0-9])")
# Openings of card numbers shorter than the base ones, by length.
_ISSUERS = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37", "1800", "2131")}
# Never personal data, so that a corpus without such lookalikes has something to learn against.
DECOYS = {
    "email": "{0} @ 5.{1} | {0} (at) {1}.{2} | {0}@{1}.{2} | {0} [at] {2}.{1}",
    "ip": "{0}.{1}.999.{2} | {2}:{1}:{0}:2024 | 3{0}-{1}-{2}-{0} | {0}, {1}, 7{2}, 400",
    "card": "2{0}00{1}00{2}0000{1} | 9{2} 000 000 {0} 000 000 000 | 1{1}-00{0}-0000{2}-00000",
    "phone": "no {0}{1}{2}7 | {0}.5.2020 {1} | 2020-10-11 {2}{0} | 1{0}00{1}00{2}0000{0}00 | {0}{1}.{2}{0}{1}",
}


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text):
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _PART.finditer(text, *chain.span())]
        for k in range(0, len(parts) - 3, 4):
            if all(b - a < 4 and int(text[a:b]) <= 255 or not text[a:b].strip("0") or int(text[a:b].lstrip("0")[:4]) <= 255 for a, b in parts[k:k + 4]):
                yield parts[k][0], parts[k + 3][1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches that pass their checks."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    found += [(1, a, b) for a, b in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Everything that may be personal data; spans overlap, base spans are among them."""
    found = {s for s in base if s[2] - s[1] <= LONGEST}
    has_digit = _PART.search(text) is not None
    for kind, name in enumerate(KINDS):
        if kind and not has_digit or not kind and "@" not in text and "(at)" not in text and "[at]" not in text:
            continue
        found |= {(kind, *m.span()) for m in _MAYBE[name].finditer(text)}
    return sorted(found)


def _masked(kind: int, body: str) -> str:
    """A span without the marks its base pattern asks for and other forms replace: separators, country code, length of a card."""
    if kind == 0:
        return _DOT.sub(".", _AT.sub("@", body))
    groups = re.findall(r"[0-9]+", body)
    if kind == 1:
        return ".".join(groups)
    if kind == 2:
        return "".join(groups)[:13]
    plain = " ".join(groups)
    coded = body.startswith("+") or plain.startswith("00")
    plain = plain.removeprefix("00")
    if (coded or len(_digits(plain)) > 10) and _COUNTRY.match(plain):
        plain = _COUNTRY.sub("", plain, count=1)
    elif len(_digits(plain)) > 10 and " " not in plain:
        plain = plain[-10:]
    return plain


def fits(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a span could be of its kind in a form other than the base one, by format and by the numbers beside it."""
    kind, a, b = span
    body, before, after = text[a:b], text[max(0, a - AROUND):a], text[b:b + AROUND]
    if kind == 0:
        # Spaces belong to bracketed forms, or stand on both sides of a sign; after a dot they end a sentence.
        return _MAIL.fullmatch(_masked(kind, body)) is not None and "," not in body and ". " not in body and " ." not in body
    if re.search(r"[0-9][ .:/-]?$|[#$€£=%<>&_]$", before) or re.match(r"[ .:/-]?[0-9]|[%€$£=]", after):
        return False
    digits, groups, marks = _digits(body), re.findall(r"[0-9]+", body), re.findall(r"[^0-9]+", body)
    hinted = _HINTED[KINDS[kind]].search(before) is not None
    if kind == 1:
        small = all(len(g) < 4 and int(g) <= 255 and (g == "0" or g[0] != "0") for g in groups)
        return small and len(set(marks)) == 1 and (hinted or max(map(int, groups)) > 99)
    if kind == 2:
        size = len(digits)
        known = 16 <= size <= 19 or digits.startswith(_ISSUERS.get(size, ("x",)))
        return known and luhn(digits) and len(set(marks)) < 2
    if not 8 <= len(digits) <= 15 or _DATE.search(body):
        return False
    if body[0] in "+(" or "(" in body or hinted:
        return True
    if len(groups) > 1 and body.startswith("00"):
        return True
    return len(groups) > 2 and min(map(len, groups[1:])) > 1 and not _AMOUNT.fullmatch(body)


def roles(text: str, base: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """What every candidate is to the trees; both lists are sorted."""
    exact, by_start = set(base), sorted((a, b, k) for k, a, b in base)
    starts = [a for a, _, _ in by_start]
    longest = max((b - a for a, b, _ in by_start), default=0)
    found = []
    for s in spans:
        if s in exact:
            found.append(BASE)
            continue
        near = by_start[bisect_left(starts, s[1] - longest):bisect_left(starts, s[2])]
        met = {k for a, b, k in near if s[1] < b}
        found.append(LEFT if s[0] in met else NOT if met or not fits(text, s) else OPEN)
    return found


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of a span and of what stands around it; none of the marks its base pattern asks for."""
    kind, a, b = span
    body, before, after = _masked(kind, text[a:b]), text[max(0, a - AROUND):a].rstrip("+"), text[b:b + AROUND]
    digits, groups = _digits(body), re.findall(r"[0-9]+", body)
    share = lambda part, test: sum(map(test, part)) / (len(part) + 1)
    near = before.lower() + " " + after.lower()
    odd = lambda c: c in "#*$%&|<>=_"
    return [
        len(body), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len({c for c in body if not c.isalnum()}), share(body, str.isalpha), share(body, str.isspace),
        float("(" in body), body.count("."), body.count("-"),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), share(before + after, str.isdigit), share(before + after, odd),
        sum(h in near for h in _HINTS[KINDS[kind]]),
        float(luhn(_digits(text[a:b]))) if kind == 2 else max((int(g[:4]) for g in groups), default=0) / 1000 if kind == 1 else 0.0,
        len(body.rsplit(".", 1)[-1]) if kind == 0 else 0.0,
    ]


def decoys() -> tuple[list[list[float]], list[int]]:
    """Features and kinds of the fixed negatives."""
    x, kinds = [], []
    for i in range(10, 20):
        for kind, name in enumerate(KINDS):
            for text in DECOYS[name].format(i, (7 * i) % 90 + 10, (13 * i) % 90 + 10).split(" | "):
                for s in candidates(text, []):
                    if s[0] == kind and not fits(text, s):
                        x.append(describe(text, s))
                        kinds.append(kind)
    return x, kinds


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


class Selector:
    """Trees and thresholds by kind; kinds without enough examples add nothing."""

    def __init__(self, forests: list[Forest | None], least: dict[int, float]):
        self.forests: dict[int, Forest] = {k: forests[k] for k in sorted(least)}
        self.thresholds = {k: max(LEAST, p) for k, p in least.items()}

    def add(self, base, spans, x: np.ndarray) -> list[tuple[int, int, int]]:
        """Base spans and the selected of ``spans``, all off them, best first where they overlap, by kind and start."""
        ranked = []
        for kind, forest in self.forests.items():
            mine = [i for i, s in enumerate(spans) if s[0] == kind]
            if mine:
                scores = forest.score(x[mine])
                ranked += [(-p, spans[i]) for p, i in zip(scores, mine) if p >= self.thresholds[kind]]
        chosen: list = []
        for _, s in sorted(ranked):
            if not any(s[1] < b and a < s[2] for _, a, b in chosen):
                chosen.append(s)
        return sorted({*base, *chosen})


def personal_data(
    docs: DataFrame, *, sample: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added for every row.

    ``spans`` lists base and added spans as kind:start:end, in code points with
    the end exclusive, by kind and then start, joined by commas; base_sha256 is
    the hash of the base ones written so. A kind's trees are fitted on four fifths of
    its base spans and sure negatives and calibrated on the others, by a hash of id and span;
    ``sample`` bounds them per kind, the first by that hash. Null and empty
    texts have no spans. Repeated rows give repeated results; other columns are
    ignored. Whole texts are read once; what is written are spans and their
    features. ``keep_text`` adds ``redacted``, the text with every span
    replaced by its kind in brackets.
    """

    def find(batches):
        for batch in batches:
            columns = {n: [] for n in ("base", "spans", "x", "roles")}
            for text in batch.column(0):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = candidates(text, base)
                columns["base"].append([v for s in base for v in s])
                columns["spans"].append([v for s in spans for v in s])
                columns["x"].append([v for s in spans for v in describe(text, s)])
                columns["roles"].append(roles(text, base, spans))
            lists = [
                pa.array(columns["base"], pa.list_(pa.int32())), pa.array(columns["spans"], pa.list_(pa.int32())),
                pa.array(columns["x"], pa.list_(pa.float32())), pa.array(columns["roles"], pa.list_(pa.int32())),
            ]
            held = [batch.column(0)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(1), *lists, *held], ["id", "base", "spans", "x", "roles", *["text"][:len(held)]])

    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, base array<int>, spans array<int>, x array<float>, roles array<int>" + (", text string" if keep_text else "")
    found = materialize(rows.mapInArrow(find, schema))
    selector = _learn(found, sample)

    def select(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            base = [_triples(v) for v in batch.column(at("base"))]
            spans = [_triples(v) for v in batch.column(at("spans"))]
            x = [np.array(v.as_py(), dtype=np.float64).reshape(-1, N_FEATURES) for v in batch.column(at("x"))]
            open_ = [[i for i, r in enumerate(v.as_py()) if r == OPEN] for v in batch.column(at("roles"))]
            every = [selector.add(b, [s[i] for i in o], f[o]) if o else b for b, s, f, o in zip(base, spans, x, open_)]
            counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(_text_of(b).encode()).hexdigest() for b in base]
            out = [
                batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([_text_of(s) for s in every], pa.string()),
                pa.array([len(s) - len(b) for s, b in zip(every, base)], pa.int64()),
            ]
            names = ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
            if keep_text:
                texts = batch.column(at("text")).to_pylist()
                out.append(pa.array([t and redact(t, s) for t, s in zip(texts, every)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(out, names)

    columns = ", ".join(f"n_{k} long" for k in KINDS)
    out = f"id {kind}, {columns}, base_sha256 string, spans string, n_added long" + (", redacted string" if keep_text else "")
    return found.mapInArrow(select, out).withColumnRenamed("id", id_col)


def _triples(values) -> list[tuple[int, int, int]]:
    flat = values.as_py()
    return list(zip(flat[::3], flat[1::3], flat[2::3]))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with spans replaced by their kinds; of overlapping ones the first by start, then the longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _learnable(found: DataFrame) -> DataFrame:
    """A row for each base span and sure negative: kind, y, mark (a hash of id and span), held (a fifth by the mark), x."""

    def unfold(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            out = []
            for id_, spans, x, marks in zip(*(batch.column(at(c)) for c in ("id", "spans", "x", "roles"))):
                features = x.as_py()
                for i, (s, role) in enumerate(zip(_triples(spans), marks.as_py())):
                    if role <= BASE:
                        mark = hashlib.blake2b(f"{id_.as_py()}:{s}".encode(), digest_size=8).digest()
                        mark = int.from_bytes(mark, "little", signed=True)
                        out.append((s[0], role, mark, mark % 5 == 4, features[i * N_FEATURES:(i + 1) * N_FEATURES]))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["kind", "y", "mark", "held", "x"])

    return found.select("id", "spans", "x", "roles").mapInArrow(unfold, _LEARNABLE)


def _lowest_of_each(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` rows of each kind, the first by their marks."""
    some = []
    for kind in range(len(KINDS)):
        own = rows.where(F.col("kind") == kind)
        some.append(own.where(F.col("mark") <= lowest(own.select(F.col("mark").alias("h")), sample)).orderBy("mark", "x").limit(sample))
    return reduce(DataFrame.union, some)


def _edges(rows: DataFrame) -> list[list[np.ndarray]]:
    """Cuts of every kind's features, at quantiles of all rows learned from.

    A candidate and its surroundings have a bounded length, so a feature has a bounded number of values, and those alone are collected.
    """

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((kind, i, v) for i, v in enumerate(x))
        if seen:
            keys = list(zip(*seen))
            types = [pa.int32(), pa.int32(), pa.float32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, t) for k, t in zip(keys, types)), pa.array(list(seen.values()), pa.int64())], ["kind", "place", "value", "n"])

    counted = rows.where("NOT held").select("kind", "x").mapInArrow(count, "kind int, place int, value float, n long")
    found = counted.groupBy("kind", "place", "value").agg(F.sum("n").alias("n")).toArrow()
    kind, place, value, n = (found.column(c).to_numpy() for c in ("kind", "place", "value", "n"))
    every = [[(kind == k) & (place == i) for i in range(N_FEATURES)] for k in range(len(KINDS))]
    return [[edges_of(value[at].astype(np.float64), n[at]) for at in own] for own in every]


def _learn(found: DataFrame, sample: int | None) -> Selector:
    """Trees and thresholds from all base spans and sure negatives among the candidates, and the fixed ones."""
    x, kinds = decoys()
    places = [kinds[:i].count(k) for i, k in enumerate(kinds)]  # of a decoy among those of its kind
    fixed = [(k, 0, i, i % 5 == 4, list(map(float, v))) for k, i, v in zip(kinds, places, x)]
    rows = _learnable(found)
    if sample is not None:
        rows = _lowest_of_each(materialize(rows), sample)
    rows = materialize(rows.union(found.sparkSession.createDataFrame(fixed, _LEARNABLE).coalesce(1)))
    edges = _edges(rows)

    def bin_(batches):
        for batch in batches:
            kind, x = batch.column(0).to_numpy(), vectors(batch.column(3), N_FEATURES).astype(np.float64)
            bins = np.zeros(x.shape, dtype=np.uint8)
            for k in np.unique(kind):
                bins[kind == k] = binned(x[kind == k], edges[k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b.tobytes() for b in bins], pa.binary())], ["kind", "y", "held", "bins"])

    cells = rows.select("kind", "y", "held", "x").mapInArrow(bin_, "kind int, y int, held boolean, bins binary")
    cells, n = materialize_counted(cells.groupBy("kind", "y", "held", "bins").agg(F.count("*").alias("n")))
    forests = fit_forests(cells, n, edges)
    return Selector(forests, thresholds(cells, n, forests, round(100 * PRECISION)))
