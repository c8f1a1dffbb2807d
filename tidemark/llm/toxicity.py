"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, weighed by context.

Fitting, on a bounded sample of labelled rows of which near copies with one label count as one, counts
how many toxic and clean texts hold each word.
Words that stand in more toxic texts than chance explains are the lexicon, each with the edits that its
length allows, its first letter like any other; a stem (a prefix that stands for all its continuations,
without edits) is added beside them only where it is in many more toxic texts than any word of the
lexicon that begins with it. A word within reach that
clean texts hold no less than toxic ones is a word of its own and no misspelling. The trie of the
lexicon and the automaton of all strings within an entry's edit distance run as one lazily determinised
machine, so a word is read once whatever the lexicon's size, and misspelled entries are found with the
exact ones. Each hit is scored in a window of words around it: inside quotation marks or beside words
of reporting it counts as quotation, beside words of address it counts as abuse. A logistic regression
over the sums of these scores gives the text's score; its weights are learned from features that each
row got by the lexicon of the other rows (`FOLDS` parts), so no row weighs a lexicon that was chosen by
it. Labels are read by the fit alone; a score sees nothing but the text.

The sample (at most `sample_rows` rows) bounds what goes to the driver: the lexicon, the sample's own
words near it and the features of its rows; what goes to executors is the model. No list of terms is cut. Scoring is one pass without a shuffle.

Defined results: words of any length end at ASCII characters other than letters and digits and at
Unicode punctuation, symbols and spaces; null, empty and blank texts have no hits and get the score of the intercept; a label
row without an id or a label is left out, of several for an id the highest label counts; without any
toxic training row every score is the smoothed share of toxic rows; rows keep all their columns.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _text as X
from ._scratch import drop, scratch

IN_WORD = X.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STEM_LENGTHS = (4, 5, 6, 7)
WINDOW = 8
#: Words near a hit; fixed values.
REPORTING = {"said", "says", "say", "wrote", "called", "calls", "quote", "quoted", "quotes", "reported", "stated", "according", "word", "term", "dit", "dijo", "sagte", "schrieb"}
ADDRESS = {"you", "your", "you're", "youre", "u", "tu", "vous", "du", "ihr", "dich", "usted", "eres"}
QUOTES = '"“”„«»'
FEATURES = 9
#: A misspelled hit counts fully only of entries in many more toxic texts than this, and than clean
#: texts with words near them by chance.
CHANCE = 10
#: Coordinates of the sketches by which the sample's near copies are known, and how many have to agree.
SKETCH, ALIKE = 16, 9
FOLDS = 3
#: A stem has to stand in so many times the toxic texts of the most frequent entry that begins with it.
STEM_GAIN = 1.5
#: How many times the share of clean texts with a term the share of toxic ones has to be.
LEAST_LIFT = 4
#: Natural logarithm of the odds against all words' chances that a lexicon entry has to show.
EVIDENCE = 3.0
_CACHED = 200_000


@lru_cache(maxsize=1)
def _separators() -> np.ndarray:
    """By code point: is it Unicode punctuation, a symbol or a space? None is beyond 0x1FFFF."""
    return np.array([c >= 0x80 and (unicodedata.category(chr(c))[0] in "PSZ" or chr(c).isspace() or c == 0x200B) for c in range(0x20000)])


def _spaced(low: np.ndarray) -> np.ndarray:
    """The bytes with blanks for those of characters that separate words."""
    leads = np.flatnonzero(low >= 0xC2)
    if not len(leads):
        return low
    b = np.r_[low, np.zeros(3, np.uint8)][leads[:, None] + np.arange(4)].astype(np.int64)
    size = 2 + (b[:, 0] >= 0xE0) + (b[:, 0] >= 0xF0)
    tail = b & 0x3F
    code = np.select([size == 2, size == 3], [(b[:, 0] & 0x1F) << 6 | tail[:, 1], (b[:, 0] & 0x0F) << 12 | tail[:, 1] << 6 | tail[:, 2]], (b[:, 0] & 0x07) << 18 | tail[:, 1] << 12 | tail[:, 2] << 6 | tail[:, 3])
    apart = (code < 0x20000) & _separators()[np.minimum(code, 0x1FFFF)]
    out = low.copy()
    for k in range(4):
        at = leads[apart & (size > k)] + k
        out[at[at < len(out)]] = 0x20
    return out


def edits_allowed(entry: str, stem: bool) -> int:
    return 0 if stem or len(entry) < 4 else 1 if len(entry) < 9 else 2


class Lexicon:
    """Words and stems; find() gives the entry within reach of a word, and its distance."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool]]] = [[]]  # entry, edits allowed, is it a stem
        self.reach = [0]
        for number, (text, stem) in enumerate(entries):
            node, edits = 0, edits_allowed(text, stem)
            self.reach[0] = max(self.reach[0], edits)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits)
            self.ends[node].append((number, edits, stem))
        self._reset()

    def _reset(self) -> None:
        self.moves: dict[int, int] = {}
        self.names: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.accepts: list[tuple[int, int] | None] = []
        self._name(((0, 0),), None)

    def _name(self, state: tuple, stem_hit: tuple[int, int] | None) -> int:
        """state: (node, edits so far), sorted; stem_hit: a stem that the word began with."""
        key = (state, stem_hit)
        if key not in self.names:
            self.names[key] = len(self.states)
            self.states.append(key)
            best = stem_hit
            for node, edits in self._with_missing(state):
                for entry, allowed, _ in self.ends[node]:
                    if edits <= allowed and (best is None or (edits, self.entries[entry][1], entry) < (best[1], self.entries[best[0]][1], best[0])):
                        best = (entry, edits)
            self.accepts.append(best)
        return self.names[key]

    def _with_missing(self, state) -> dict[tuple[int, int], None]:
        """The state, and where leaving out characters of an entry leads."""
        out, open_ = dict.fromkeys(state), list(state)
        while open_:
            node, edits = open_.pop()
            if edits < self.reach[node]:
                for child in self.children[node].values():
                    new = (child, edits + 1)
                    if edits + 1 <= self.reach[child] and new not in out:
                        out[new] = None
                        open_.append(new)
        return out

    def _step(self, name: int, c: str) -> int:
        state, stem_hit = self.states[name]
        best: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < best.get(node, 99):
                best[node] = edits

        for node, edits in self._with_missing(state):
            child = self.children[node].get(c)
            if child is not None:
                put(child, edits)
            put(node, edits + 1)
            for other, to in self.children[node].items():
                if other != c:
                    put(to, edits + 1)
        for node, edits in best.items():
            for entry, allowed, stem in self.ends[node]:
                if stem and edits <= allowed and (stem_hit is None or edits < stem_hit[1]):
                    stem_hit = (entry, edits)
        return self._name(tuple(sorted(best.items())), stem_hit)

    def find(self, word: str) -> tuple[int, int] | None:
        """(entry, edits) of the entry nearest to the word, or None."""
        if len(self.states) > 100_000:
            self._reset()
        moves, name = self.moves, 0
        for c in word:
            key = name << 21 | ord(c)
            to = moves.get(key)
            if to is None:
                to = moves[key] = self._step(name, c)
            name = to
            if not self.states[name][0]:
                break
        return self.accepts[name]


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[tuple[str, bool], ...]
    strengths: tuple[float, ...]
    weights: tuple[float, ...]  # intercept first
    own_words: frozenset[str] = frozenset()  # within reach of an entry, but no misspellings
    credits: tuple[float, ...] = ()  # by entry, what a misspelled hit counts of an exact one


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.lexicon = model, Lexicon(list(model.entries))
        self.known: dict[bytes, int] = {}

    def _codes(self, words: list[bytes]) -> np.ndarray:
        """For each distinct word 0, or 1 + 4 * entry + edits."""
        if len(self.known) > _CACHED:
            self.known.clear()
        known = self.known
        found = [known.get(w, -1) for w in words]
        for i, code in enumerate(found):
            if code < 0:
                word = words[i].decode(errors="replace").lower()
                hit = self.lexicon.find(word)
                if hit is not None and hit[1] and word in self.model.own_words:
                    hit = None
                found[i] = 0 if hit is None else 1 + 4 * hit[0] + hit[1]
                if len(words[i]) <= 48:
                    known[words[i]] = found[i]
        return np.array(found, np.int64)

    def features(self, data: np.ndarray, offsets: np.ndarray, misspelled: bool = False) -> np.ndarray:
        """One row per text: exact and misspelled hits, each abusive, neutral and quoted (logarithms of
        summed strengths), the largest number of hits in one window, hits per word, and misspelled ones;
        with misspelled, as if every hit were misspelled (and those that can't be, none)."""
        out = np.zeros((len(offsets) - 1, FEATURES))
        low = _spaced(_LOWER[data])
        starts, ends, at = X.words(low, offsets, IN_WORD)
        if not len(starts):
            return out
        inverse, distinct = X.distinct(low, starts, ends)
        codes = self._codes(distinct.to_pylist())
        if misspelled:
            budgets = np.array([edits_allowed(*e) for e in self.model.entries] + [0])
            codes = np.where(codes % 4 == 1, np.where(budgets[(codes - 1) // 4] > 0, codes + 1, 0), codes)
        codes = codes[inverse]
        hits = np.flatnonzero(codes)
        if not len(hits):
            return out
        raw = data.tobytes()
        rows = np.searchsorted(at, hits, side="right") - 1
        counts = np.ones(len(hits))
        edited = (codes[hits] - 1) % 4 > 0
        if self.model.credits:
            counts[edited] = np.array(self.model.credits)[(codes[hits[edited]] - 1) // 4]
        for h, r, code, count in zip(hits.tolist(), rows.tolist(), codes[hits].tolist(), counts.tolist()):
            a, b = max(h - WINDOW, int(at[r])), min(h + WINDOW + 1, int(at[r + 1]))
            before = raw[starts[a] : starts[h]].decode(errors="replace")
            after = raw[ends[h] : ends[b - 1]].decode(errors="replace")
            near = set(before.lower().split()) | set(after.lower().split())
            marks = sum(before.count(q) for q in QUOTES)
            quoted = (marks % 2 == 1 and any(q in after for q in QUOTES)) or bool(near & REPORTING)
            kind = 2 if quoted else 0 if near & ADDRESS else 1
            entry, edits = divmod(code - 1, 4)
            out[r, kind + 3 * (edits > 0)] += count * (self.model.strengths[entry] if self.model.strengths else 1.0)
        ends_of = np.searchsorted(hits, hits + WINDOW, side="right")
        ends_of = np.minimum(ends_of, np.searchsorted(rows, rows, side="right"))
        sums = np.r_[0, np.cumsum(counts)]
        np.maximum.at(out[:, 6], rows, np.log1p(sums[ends_of] - sums[:-1]))
        n_words = np.maximum(np.diff(at), 1)
        out[:, 7] = np.sqrt(np.bincount(rows, weights=counts, minlength=len(out)) / n_words)
        out[:, 8] = np.sqrt(np.bincount(rows, weights=counts * edited, minlength=len(out)) / n_words)
        out[:, :6] = np.log1p(out[:, :6])
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        w = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + features @ w[1:], -30, 30)))


def _terms(text: str) -> set[str]:
    low = _spaced(_LOWER[np.frombuffer(text.encode(), np.uint8)])
    starts, ends, _ = X.words(low, np.array([0, len(low)]), IN_WORD)
    raw = low.tobytes()
    found = {raw[a:b].decode(errors="replace").lower() for a, b in zip(starts.tolist(), ends.tolist())}
    stems = {w[:n] + "*" for w in found for n in STEM_LENGTHS if len(w) > n}
    return found | stems


def _sketch(batches):
    """A signature of each text's runs of three words; none for a text without words."""
    from .minhash import DartMinHash, shingle_sets

    hasher = DartMinHash(SKETCH)
    for batch in batches:
        for first, data, offsets in X.slices(batch.column(2)):
            n = len(offsets) - 1
            elements, at = shingle_sets(data, offsets, 3)
            filled = np.flatnonzero(np.diff(at) > 0)
            made = [[] for _ in range(n)]
            if len(filled):
                for r, s in zip(filled.tolist(), hasher.signatures(elements, np.ones(len(elements)), np.r_[at[filled], at[-1]]).view(np.int64).tolist()):
                    made[r] = s
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(made, pa.list_(pa.int64()))], names=["number", "label", "sketch"])


def _unlike(rows: list[tuple[int, int, list[int]]]) -> list[int]:
    """Of (number, label, sketch) rows the smallest number of each group of one label whose sketches agree
    in ALIKE coordinates, over any number of steps; rows without a sketch stand for themselves."""
    empty = [r[0] for r in rows if not r[2]]
    rows = sorted(r for r in rows if r[2])
    out = {r[0]: r[0] for r in rows}
    sketches = np.array([r[2] for r in rows], np.int64).reshape(len(rows), SKETCH)

    def find(i):
        while out[i] != i:
            i = out[i]
        return i

    firsts: dict[tuple, list[int]] = {}
    for place, (number, label, sketch) in enumerate(rows):
        for pair in range(0, len(sketch), 2):
            # unlike texts of a band are met one by one: each is compared with those that began a group
            heads = firsts.setdefault((label, pair, sketch[pair], sketch[pair + 1]), [])
            for head in heads:
                if (sketches[head] == sketches[place]).sum() >= ALIKE:
                    a, b = find(rows[head][0]), find(number)
                    out[max(a, b)] = min(a, b)
                    break
            else:
                heads.append(place)
    return [n for n in out if find(n) == n] + empty


def _count_terms(batches):
    """Per term, how many toxic and clean texts of each fold hold it."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for term in _terms(text or ""):
                counts.setdefault(term, [0] * (2 * FOLDS))[2 * fold + (label == 0)] += 1
    terms = list(counts)
    for i in range(0, len(terms), 50_000):
        part = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([counts[t][k] for t in part], pa.int64()) for k in range(2 * FOLDS)]], names=["term", *_COUNTS])


_COUNTS = [f"{kind}{fold}" for fold in range(FOLDS) for kind in ("toxic", "clean")]


def _counts_without(row, fold: int | None) -> tuple[int, int]:
    """Toxic and clean texts of a term, but for those of a fold."""
    return tuple(sum(row[f"{kind}{f}"] for f in range(FOLDS) if f != fold) for kind in ("toxic", "clean"))


def _evidence(toxic: int, clean: int, share: float) -> float:
    """How unlikely (bound of a tail, as a negative logarithm) so many toxic of all a word's texts are."""
    n = toxic + clean
    rate = toxic / n
    if rate <= share:
        return 0.0
    return n * (rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0))


def _chosen(rows, fold: int | None, n_toxic: int, n_clean: int, n_words: int) -> tuple[list[tuple[str, bool]], list[float], list[int]]:
    """Entries, strengths and numbers of toxic texts of the lexicon of all rows but those of a fold."""
    if not n_toxic or not n_clean:
        return [], [], []
    found = []
    for row in rows:
        toxic, clean = _counts_without(row, fold)
        lift = np.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))
        evidence = _evidence(toxic, clean, n_toxic / (n_toxic + n_clean)) if toxic else 0.0
        if toxic >= 3 and lift >= np.log(LEAST_LIFT) and evidence >= np.log(max(n_words, 1)) + EVIDENCE:
            found.append((row.term.removesuffix("*"), row.term.endswith("*"), float(lift), toxic, evidence))
    out = [f for f in found if not f[1]]
    most: dict[str, int] = {}  # toxic texts of the most frequent word that begins so
    for text, _, _, toxic, _ in out:
        for n in STEM_LENGTHS:
            if len(text) >= n:
                most[text[:n]] = max(most.get(text[:n], 0), toxic)
    stems: set[str] = set()
    for f in sorted((f for f in found if f[1]), key=lambda f: (-f[4], -len(f[0]), f[0])):
        nested = any(f[0].startswith(s) or s.startswith(f[0]) for s in stems)
        if not nested and f[3] >= STEM_GAIN * most.get(f[0], 0):
            stems.add(f[0])
            out.append(f)
    out.sort(key=lambda f: (-f[3], f[0], f[1]))
    return [(f[0], f[1]) for f in out], [f[2] for f in out], [f[3] for f in out]


def _misspelled(batches, lexicons: list[Lexicon]):
    """Words of the sample that a lexicon (model) finds by edits, and the entry."""
    every = Lexicon(sorted({e for lexicon in lexicons for e in lexicon.entries}))
    for batch in batches:
        batch = batch.filter(pa.array([every.find(t) is not None for t in batch.column(0).to_pylist()], pa.bool_()))
        terms = batch.column(0).to_pylist()
        for model, lexicon in enumerate(lexicons):
            found = [lexicon.find(t) or (0, 0) for t in terms]
            named = pa.RecordBatch.from_arrays([*batch.columns, pa.array([model] * len(found), pa.int64()), pa.array([e for e, _ in found], pa.int64())], names=["term", *_COUNTS, "model", "entry"])
            yield named.filter(pa.array([edits > 0 for _, edits in found], pa.bool_()))


def _regress(x: np.ndarray, y: np.ndarray, each: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps; each: the weights of the rows."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    w[0] = np.log((each @ y + 0.5) / (each @ (1 - y) + 0.5))
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def loss(w):
        z = x @ w
        return each @ (np.logaddexp(0, z) - y * z) + w @ penalty @ w / 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w)), x.T @ (each * (y - p)) - penalty @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-6:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows that a model may learn labels from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000) -> ToxicityModel:
    """Fit on at most `sample_rows` labelled training rows, those with the smallest hash of their id."""
    marked = labels.where(training_rows(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    marked = marked.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = X.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked), "id")
    every = rows.select("text", (F.col("label") > 0).cast("int").alias("label"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    every = scratch(every.dropDuplicates(["text", "label"]).withColumn("number", F.monotonically_increasing_id()))
    # one of each group of near copies, or words that they share by descent would seem to go with their label
    sketched = every.select("number", "label", "text").mapInArrow(_sketch, "number long, label int, sketch array<long>").collect()
    kept = docs.sparkSession.createDataFrame([(n,) for n in _unlike([(r.number, r.label, r.sketch) for r in sketched])], "number long")
    rows = scratch(every.join(F.broadcast(kept), "number").select("text", "label", "fold"))
    drop(every)
    sizes = {(r.label, r.fold): r.n for r in rows.groupBy("label", "fold").agg(F.countDistinct("text").alias("n")).collect()}
    n_toxic, n_clean = (sum(n for (label, _), n in sizes.items() if label == x) for x in (1, 0))
    if not n_toxic:
        return ToxicityModel((), (), (float(np.log(0.5 / (n_clean + 0.5))),) + (0.0,) * FEATURES)
    counted = rows.dropDuplicates(["text"]).mapInArrow(_count_terms, ", ".join(["term string", *[f"{c} long" for c in _COUNTS]])).groupBy("term").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    counted = scratch(counted)
    word = ~F.col("term").endswith("*")
    n_words = counted.where(word).count()
    toxic, clean = (sum((F.col(f"{kind}{f}") for f in range(1, FOLDS)), F.col(f"{kind}0")) for kind in ("toxic", "clean"))
    candidates = counted.where((toxic >= 3) & (toxic > clean)).collect()
    made = []
    for fold in (None, *range(FOLDS)):
        t, c = (sum(n for (label, f), n in sizes.items() if label == x and f != fold) for x in (1, 0))
        made.append((*_chosen(candidates, fold, t, c, n_words), t, c))
    near = counted.where(word).mapInArrow(lambda batches: _misspelled(batches, [Lexicon(m[0]) for m in made]), ", ".join(["term string", *[f"{c} long" for c in _COUNTS], "model long", "entry long"])).collect()
    models = []
    for number, (entries, strengths, held, t, c) in enumerate(made):
        counts = [(r, *_counts_without(r, number - 1 if number else None)) for r in near if r.model == number]
        own = frozenset(r.term for r, x, y in counts if y >= 2 and y * t > x * c)
        by_chance = Counter()
        for r, _, y in counts:
            by_chance[r.entry] += y if r.term not in own else 0
        credits = tuple(h / (h + CHANCE * (1 + by_chance[i])) for i, h in enumerate(held))
        models.append(ToxicityModel(tuple(entries), tuple(strengths), (0.0,) * (FEATURES + 1), own, credits))
    model, folds = models[0], models[1:]
    measured = rows.mapInArrow(_featurize(folds), "label int, features array<double>, share double").collect()
    drop(rows, counted)
    x, y = np.array([r.features for r in measured]).reshape(-1, FEATURES), np.array([r.label for r in measured], float)
    each = np.array([r.share for r in measured])
    if not len(y) or y.sum() in (0, len(y)):
        weights = (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))),) + (0.0,) * FEATURES
    else:
        weights = tuple(map(float, _regress(x, y, each)))
    return ToxicityModel(model.entries, model.strengths, weights, model.own_words, model.credits)


def _featurize(models: list[ToxicityModel]):
    """Label, features (by the model of the row's fold, which is of the other rows) and weight of each
    row. A toxic row comes at half weight as it is, and at the other half as if misspelled: labelled
    texts spell most terms right, and would teach nothing of texts that don't."""

    def run(batches):
        scorers = [Scorer(m) for m in models]
        for batch in batches:
            for fold, scorer in enumerate(scorers):
                part = batch.filter(pc.equal(batch.column(2), fold))
                for first, data, offsets in X.slices(part.column(0)):
                    label = np.array(part.column(1).slice(first, len(offsets) - 1).to_pylist(), np.int32)
                    f, toxic = scorer.features(data, offsets), label > 0
                    f = np.r_[f, scorer.features(data, offsets, misspelled=True)[toxic]]
                    share = np.r_[np.where(toxic, 0.5, 1.0), np.full(toxic.sum(), 0.5)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[label, label[toxic]]), pa.array(f.tolist(), pa.list_(pa.float64())), pa.array(share)], names=["label", "features", "share"])

    return run


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows of docs with all their columns and their score between 0 and 1."""
    if score_col in docs.columns:
        raise ValueError(f"docs has a column {score_col}; name another")
    at, columns = X.place_of(docs.columns, text_col), docs.columns

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            text = batch.column(at).cast(pa.string()) if batch.num_rows else batch.column(at)
            parts = [scorer.scores(scorer.features(data, offsets)) for _, data, offsets in X.slices(text)]
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*columns, score_col])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(score_col, T.DoubleType())])
    return X.numbered(docs).mapInArrow(run, schema)
