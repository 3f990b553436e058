"""Toxicity by a learned lexicon, matched with Levenshtein automata, and by the context of each match.

The lexicon is a trie of words and of word stems. Its product with the
Levenshtein automata of all its entries is a deterministic automaton whose
states are sets of (trie node, errors so far); states are made when a text first
needs them, and most words leave it after two or three letters. A window around
every match tells a quotation, where the word is mentioned, from abuse.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tipoff.llm.common import held_out
from tipoff.llm.labelled import SAMPLE, fit_logistic, predicted, training_labels
from tipoff.session import materialize

TOKEN = re.compile(r"[^\W\d_]+")
# A word with digits in it or before it, and with symbols between its letters; what digits and symbols usually stand for.
DISGUISED = re.compile(r"(?:[^\W_]|[@$](?=[^\W\d_]))(?:[^\W_]++|[@$!*#]++(?=[^\W_]))*+")
STAND_INS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
MASKS = "*#"  # any letter
MARKED = re.compile(r"[\d@$!*#]")
STEMS = (4, 5, 6, 7)  # lengths of stems that may enter the lexicon
SHORTEST = 4
TERMS = 1000  # entries of the lexicon, at most
CANDIDATES = 20_000  # terms looked at to choose them
WINDOW = 6  # words to either side of a match
THRESHOLD = 0.5
CACHE = 1 << 18  # words whose match is remembered in a task
STATES = 1 << 15  # states of the automaton that are remembered in a task
N_FEATURES = 6
SHINGLE = 4

QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "'": "'"}
# Words that report speech or mention a word, and words that address someone.
REPORTING = frozenset(
    "said says wrote writes called calls word words term terms quote quoted quoting reported reports"
    " sagte sagt schrieb nannte wort begriff zitat dijo dice escribió llamó palabra término cita"
    " dit écrit appelé mot terme citation".split()
)
ADDRESSING = frozenset("you your yours youre du dein dich dir ihr euch tu te tú ti usted vous toi votre".split())


def errors_allowed(term: str, stem: bool) -> int:
    """Edits a term may be misspelt by: none for the shortest, two for long words."""
    size = len(term)
    return (0 if size < 6 else 1) if stem else (0 if size < 5 else 1 if size < 8 else 2)


class Automaton:
    """All lexicon entries with their misspellings, as one lazily built deterministic automaton.

    Usual stand-ins for a letter, and masks of at most half of a word, are no
    errors; other digits and symbols are wrong letters. ``match(word)`` gives
    (term number, errors) of the closest entry, or None. With ``first_kept``
    the first letter of a term must be right.
    """

    def __init__(self, terms: list[tuple[str, bool]], first_kept: bool = True):
        self.first_kept = first_kept
        self.children: list[dict] = [{}]
        self.words: list[int] = [-1]
        self.stems: list[int] = [-1]
        self.budget: list[int] = [0]  # most errors of any term below a node
        self.allowed = [errors_allowed(t, s) for t, s in terms]
        for number, (term, stem) in enumerate(terms):
            node = 0
            for c in term:
                self.budget[node] = max(self.budget[node], self.allowed[number])
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.words.append(-1)
                    self.stems.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
            self.budget[node] = max(self.budget[node], self.allowed[number])
            (self.stems if stem else self.words)[node] = number
        self.letters = {c for t, _ in terms for c in t}
        self._forget()

    def _forget(self):
        self.sets: list = [(frozenset(), None)]  # state 0 is dead
        self.numbers: dict = {self.sets[0]: 0}
        self.moves: list[dict] = [{}]
        self.ends: list = [None]
        self.start = self._state({(0, 0)}, None)

    def _state(self, positions: set, found) -> int:
        """Number of the state of these positions and of the best stem passed so far."""
        least: dict = {}
        todo = list(positions)
        while todo:  # a letter of the term may be missing
            node, e = todo.pop()
            if e > self.budget[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            if node or not self.first_kept:
                todo += [(child, e + 1) for child in self.children[node].values()]
        for node, e in least.items():
            stem = self.stems[node]
            if stem >= 0 and e <= self.allowed[stem] and (found is None or (e, stem) < found):
                found = (e, stem)
        key = (frozenset(least.items()), found)
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.words[n]) for n, e in least.items() if self.words[n] >= 0 and e <= self.allowed[self.words[n]]]
            best = min([*ends, *([found] if found else [])], default=None)
            self.ends.append(best and (best[1], best[0]))
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        positions, found = self.sets[state]
        after = set()
        for node, e in positions:
            if c in MASKS and c:
                after.update((k, e) for k in self.children[node].values())
            for letter in STAND_INS.get(c, c):
                child = self.children[node].get(letter)
                if child is not None:
                    after.add((child, e))
            if node or not self.first_kept:  # another letter in its place, or one too many
                after.add((node, e + 1))
                after.update((k, e + 1) for k in self.children[node].values())
        return self._state(after, found)

    def match(self, word: str):
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        masked = sum(map(word.count, MASKS)) * 2 <= len(word)
        for c in word:
            if c not in self.letters and c not in STAND_INS and not (masked and c in MASKS):
                c = ""
            moves = self.moves[state]
            following = moves.get(c)
            if following is None:
                following = moves[c] = self._move(state, c)
            if not following:
                return None
            state = following
        return self.ends[state]


def context_weight(before: str, after: str) -> float:
    """What a match counts between these two pieces of text: less if it is quoted or reported, more if addressed."""
    left, right = TOKEN.findall(before), TOKEN.findall(after)
    weight = 1.0
    for opening, closing in QUOTES.items():
        at = before.rfind(opening)
        if at < 0 or (opening == "'" and at and before[at - 1].isalpha()):
            continue
        if any(c in before[at + 1:] for c in closing) or (opening in closing and before.count(opening) % 2 == 0):
            continue
        if any(c in after for c in closing):
            weight *= 0.25
            break
    if REPORTING & set(left) or REPORTING & set(right[:2]):
        weight *= 0.5
    elif weight == 1.0 and ADDRESSING & {*left, *right}:
        weight *= 1.25
    return weight


class Matcher:
    """Features of texts by one lexicon."""

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.weights = [w for _, _, w in terms]
        self.automaton = Automaton([(t, s) for t, s, _ in terms], first_kept=False)
        self.good: dict = {}
        self.known: set = set()

    def look_up(self, word: str):
        """The match of a token; of one with digits or symbols None where a piece of it matches as well."""
        found = self.automaton.match(word) if len(word) >= SHORTEST - 1 else None
        if found and not word.isalpha():
            for piece in TOKEN.findall(word):
                other = self.automaton.match(piece) if len(piece) >= SHORTEST - 1 else None
                if other and other[1] <= found[1]:
                    return None
        return found

    def hit(self, word: str):
        if word not in self.known:
            self.known.add(word)
            found = self.look_up(word)
            if found:
                self.good[word] = found
        return self.good.get(word)

    def words(self, lower: str) -> list[tuple[int, int]]:
        """Spans of runs of letters, and of disguised words that match as a whole."""
        if not MARKED.search(lower):
            return [m.span() for m in TOKEN.finditer(lower)]
        spans = []
        for m in DISGUISED.finditer(lower):
            w = m.group()
            if w.isalpha():
                spans.append(m.span())
            elif TOKEN.search(w) and self.hit(w):
                spans.append(m.span())
            else:
                spans += [p.span() for p in TOKEN.finditer(lower, *m.span())]
        return spans

    def features(self, text: str) -> list[float]:
        """Weighted matches by errors (0, 1, 2), the strongest one, their share of words, and what context took off."""
        lower = text.lower()
        if len(self.known) > CACHE:
            self.known.clear()
            self.good.clear()
        spans = self.words(lower)
        words = [lower[a:b] for a, b in spans]
        distinct = set(words)
        for w in distinct - self.known:
            self.hit(w)
        if self.good.keys().isdisjoint(distinct):
            return [0.0] * N_FEATURES
        sums, strongest, plain = [0.0, 0.0, 0.0], 0.0, 0.0
        for i, w in enumerate(words):
            hit = self.good.get(w)
            if hit is None:
                continue
            term, errors = hit
            before = lower[spans[max(0, i - WINDOW)][0]:spans[i][0]]
            after = lower[spans[i][1]:spans[min(len(spans) - 1, i + WINDOW)][1] + 1]
            # A quotation mark may stand right before the window's first word.
            value = context_weight(lower[max(0, spans[max(0, i - WINDOW)][0] - 1):spans[max(0, i - WINDOW)][0]] + before, after)
            value *= self.weights[term]
            sums[errors] += value
            plain += self.weights[term]
            strongest = max(strongest, value if not errors else 0.5 * value)
        total = sum(sums)
        return [*np.log1p(sums).tolist(), strongest, float(np.log1p(100 * total / len(words))), float(np.log1p(max(0.0, plain - total)))]


def _one_of_copies(sampled: DataFrame) -> DataFrame:
    """The sample with one document of each group of near copies, so that their words are not taken for evidence.

    Copies share the smallest hash of their word shingles; three seeds are taken in turn.
    """

    def sign(batches):
        for batch in batches:
            marks = []
            for text in batch.column(0):
                words = (text.as_py() or "").lower().split()
                shingles = {" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
                marks.append([min(xxhash.xxh64_intdigest(w, seed) >> 1 for w in shingles) for seed in range(3)])
            columns = [pa.array(c, pa.int64()) for c in zip(*marks)] if marks else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "s0", "s1", "s2"])

    signed = sampled.select("text", "y", "id").mapInArrow(sign, f"text string, y int, id {sampled.schema['id'].dataType.simpleString()}, s0 long, s1 long, s2 long")
    for mark in ("s0", "s1", "s2"):
        first = F.min_by(F.struct("text", "y", "id", "s0", "s1", "s2"), "id").alias("row")
        signed = signed.groupBy("y", mark).agg(first).select("row.*")
    return signed.select("text", "y", "id")


def _term_counts(sampled: DataFrame) -> DataFrame:
    """(term, stem, pos, neg): sampled documents of either label that have the word, or a word with the stem."""

    def count(batches):
        counts: tuple = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = {w for w in TOKEN.findall((text.as_py() or "").lower()) if len(w) >= SHORTEST}
                terms = {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}
                counts[y].update(terms)
        terms = list(counts[1])  # a term of no toxic document is of no use
        yield pa.RecordBatch.from_arrays([
            pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
            pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([0] * len(terms), pa.int64()),
        ], ["term", "stem", "pos", "neg"])
        rest = list(counts[0])
        yield pa.RecordBatch.from_arrays([
            pa.array([t for t, _ in rest], pa.string()), pa.array([s for _, s in rest], pa.bool_()),
            pa.array([0] * len(rest), pa.int64()), pa.array([counts[0][t] for t in rest], pa.int64()),
        ], ["term", "stem", "pos", "neg"])

    found = sampled.mapInArrow(count, "term string, stem boolean, pos long, neg long")
    return found.groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos > 1")


def choose_terms(rows: list, limit: int = TERMS) -> list[tuple[str, bool, float]]:
    """Entries (term, is a stem, weight) from (term, stem, pos, neg, evidence, weight), the strongest first.

    Of a term and its beginnings or continuations the strongest one enters;
    with equal evidence a whole word before a stem, then the longer one.
    """
    chosen: list = []
    taken: set = set()  # entries and all their beginnings
    stems: set = set()
    for term, stem, _, _, _, weight in sorted(rows, key=lambda r: (-round(r[4], 6), r[1], -len(r[0]), r[0])):
        if term in taken or any(term[:k] in stems for k in STEMS if k <= len(term)):
            continue
        chosen.append((term, stem, weight))
        taken.update(term[:k] for k in range(SHORTEST, len(term) + 1))
        if stem:
            stems.add(term)
        if len(chosen) == limit:
            break
    return chosen


def learn_lexicon(sampled: DataFrame, *, terms: int = TERMS) -> list[tuple[str, bool, float]]:
    """Words and stems far more frequent in toxic documents than in others, with weights between 0 and 1.

    Near copies count once.

    Evidence is the likelihood ratio of the 2 x 2 table; its bar rises with
    the number of terms looked at, so chance finds none.
    """
    sampled = materialize(_one_of_copies(sampled))
    totals = {r.y: r.n for r in sampled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    counts = materialize(_term_counts(sampled))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    share = (a + b) / (toxic + clean)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    evidence = 2 * (
        part(a, share * toxic) + part(b, share * clean)
        + part(toxic - a, (1 - share) * toxic) + part(clean - b, (1 - share) * clean)
    )
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    looked_at = counts.count()
    bar = 2 * float(np.log(max(looked_at, 2))) + 4
    found = counts.withColumns({"evidence": evidence, "weight": F.least(F.lit(1.0), odds / 4)}).where(
        (F.col("evidence") >= bar) & (odds > 1.5)
    )
    rows = found.orderBy(F.desc("evidence"), "term", "stem").limit(CANDIDATES).collect()
    return choose_terms([tuple(r) for r in rows], terms)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted and the match features of every row.

    Lexicon and weights are learned from ``labels.toxic`` of at most ``sample``
    documents outside the held-out fold. Whole texts are matched; a text
    without a match, also an empty or null one, gets the model's base score.
    Repeated rows give repeated results; of repeated rows of a training
    document one counts. Without labels of both kinds the score is the smoothed
    share of toxic ones. Texts are read twice, nothing is shuffled but the
    sample's term counts.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    known = materialize(training_labels(labels, "toxic", sample=sample))
    # Whole texts of the sample, one per id; the ids are at most ``sample`` numbers.
    sampled = rows.join(F.broadcast(known), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    sampled = materialize(sampled.select("text", "y", "id"))
    lexicon = learn_lexicon(sampled)

    def measure(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([matcher.features(t.as_py() or "") for t in batch.column(0)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *[pa.array(c) for c in x.T]], [*batch.schema.names[1:], *names]
            )

    names = ["exact", "one_error", "two_errors", "strongest", "share", "quoted"]
    columns = ", ".join(f"{n} double" for n in names)
    kind = rows.schema["id"].dataType.simpleString()
    fitted = sampled.select("text", "y").mapInArrow(measure, f"y int, {columns}").toArrow()
    y = fitted.column("y").to_numpy().astype(np.float64)
    x = np.stack([fitted.column(n).to_numpy() for n in names], axis=1)
    if len(y) and y.min() < y.max():
        weights = fit_logistic(x, y)
    else:
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        weights = np.array([np.log(rate / (1 - rate)), *[0.0] * N_FEATURES])
    z = F.lit(float(weights[0]))
    for name, w in zip(names, weights[1:]):
        z = z + F.lit(float(w)) * F.col(name)
    found = rows.mapInArrow(measure, f"id {kind}, {columns}")
    scored = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        predicted(F.col("score"), threshold).alias("predicted"), *names,
    )
