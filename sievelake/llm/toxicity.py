"""Toxicity by a learned lexicon, matched with misspellings, weighed by context.

Terms and stems that mark toxic documents are learned from a bounded sample of labelled rows and
kept in a trie. A text's words run through the determinised intersection of that trie with
Levenshtein automata, whose states are built as words need them: a word dies after a letter or two
unless a term is near. A match counts less in a quotation or an attribution than in plain speech;
how much less, and what a match at a distance is worth, comes from the same sample.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Scratch, readable
from sievelake.llm.neardup import order_minhash, symbols, word_hashes

WORD = re.compile(r"[^\W\d_]+")
END = "$"
STEM = range(3, 13)
WINDOW = 12
OPENING, CLOSING, STRAIGHT = "“«„‹‘", "”»“›’", '"'
#: Quotations, whose words teach nothing about plain ones.
QUOTED = re.compile(r'(?:(?<=[\s([{])|^)"[^"\n]{1,200}"|“[^”\n]{1,200}”|«[^»\n]{1,200}»|„[^“\n]{1,200}“')
#: Words that attribute what stands beside them to someone else.
ATTRIBUTION = frozenset("said says wrote writes quoted quotes called quote alleged claimed reported sagte schrieb zitierte nannte dit écrit cité appelé dijo escribió citó llamó".split())
#: Of a task: chunks and moves that are kept, and the letters of the longest chunk that is.
CACHE_ENTRIES, CACHE_LETTERS = 400_000, 40


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def allowed(term: str) -> int:
    """Edits at which a term still counts: none for short ones."""
    n = len(term.rstrip(END))
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Matches words against terms at a Levenshtein distance. A term that ends in ``$`` is a whole word, any other a stem."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.most: list[int] = [0]
        for i, term in enumerate(terms):
            node = 0
            for c in ["", *term.rstrip(END)]:
                if c:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(None)
                        self.most.append(0)
                    node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed(term))
            # where a stem and a word coincide, the stem covers the word
            if self.ends[node] is None or not term.endswith(END):
                self.ends[node] = i
        self._forget()

    def _forget(self) -> None:
        start = self._closed({(0, 0)})
        self.states = {(start, frozenset()): 0}
        self.content = [(start, frozenset())]
        self.moves: list[dict[str, int]] = [{}]
        self.known = 0

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the terms' letters that a word leaves out."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, errors = todo.pop()
            if errors <= self.most[node] and errors < best.get(node, 9):
                best[node] = errors
                todo += [(child, errors + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _hits(self, states: frozenset, stems: bool) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, errors in states:
            if (i := self.ends[node]) is not None and errors <= allowed(self.terms[i]) and self.terms[i].endswith(END) != stems:
                out[i] = min(errors, out.get(i, 9))
        return out

    def _move(self, at: int, c: str) -> int:
        states, kept = self.content[at]
        to = set()
        for node, errors in states:
            to.add((node, errors + 1))
            for letter, child in self.children[node].items():
                to.add((child, errors + (letter != c)))
        states = self._closed(to)
        best = dict(kept)
        for i, e in self._hits(states, stems=True).items():
            best[i] = min(e, best.get(i, 9))
        key = (states, frozenset(best.items()))
        if key not in self.states:
            self.states[key] = len(self.content)
            self.content.append(key)
            self.moves.append({})
        found = self.moves[at][c] = self.states[key]
        self.known += 1
        return found

    def match(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of the nearest terms."""
        if self.known > CACHE_ENTRIES:
            self._forget()
        at = 0
        for c in word:
            nxt = self.moves[at].get(c)
            at = self._move(at, c) if nxt is None else nxt
            if not self.content[at][0] and not self.content[at][1]:
                return []
        states, kept = self.content[at]
        hits = dict(kept)
        for i, e in self._hits(states, stems=False).items():
            hits[i] = min(e, hits.get(i, 9))
        nearest = min(hits.values(), default=0)
        return sorted((i, e) for i, e in hits.items() if e == nearest)


class Matcher(dict):
    """Matches of white-space-free chunks of text, kept as they come again and again."""

    def __init__(self, terms: list[str]):
        self.automaton = Automaton(terms)

    def __missing__(self, chunk: str) -> tuple:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        out = tuple(m for w in WORD.findall(chunk) for m in self.automaton.match(w))
        if len(chunk) <= CACHE_LETTERS:
            self[chunk] = out
        return out

    def hits(self, text: str) -> dict[tuple[int, int], list[float]]:
        """(term, distance): plain and quoted occurrences."""
        chunks = text.lower().split()
        found = list(map(self.__getitem__, chunks))
        out: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.0, 0.0])
        if any(found):
            for at, matches in enumerate(found):
                if matches:
                    q = quotation(chunks, at)
                    for m in matches:
                        out[m][0] += 1 - q
                        out[m][1] += q
        return out


def quotation(chunks: list[str], at: int) -> float:
    """1 inside quotation marks that open and close within the window, 0.5 beside an attribution, else 0."""
    before, after = " ".join([*chunks[max(0, at - WINDOW) : at], ""]), " ".join(["", *chunks[at + 1 : at + 1 + WINDOW]])
    own = chunks[at]
    m = WORD.search(own)
    before, after = before + own[: m.start() if m else 0], own[m.end() if m else len(own) :] + after
    opened = max(before.rfind(c) for c in OPENING)
    if opened >= 0 and opened > max(before.rfind(c) for c in "”»›’") and any(c in after for c in CLOSING):
        return 1.0
    straight = before.rfind(STRAIGHT)
    if straight >= 0 and (straight == 0 or before[straight - 1].isspace() or before[straight - 1] in "([{:,") and STRAIGHT in after:
        return 1.0
    near = {x.strip(".,:;!?()") for x in chunks[max(0, at - 4) : at + 5]}
    return 0.5 if near & ATTRIBUTION else 0.0


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    coefficients: tuple[float, float, float] = (-3.0, 1.0, 0.2)

    def features(self, hits: dict[tuple[int, int], list[float]]) -> tuple[float, float]:
        plain = quoted = 0.0
        for m, (p, q) in hits.items():
            w = self.weights.get(m, 0.0)
            plain, quoted = plain + w * np.log1p(p), quoted + w * np.log1p(q)
        return plain, quoted

    def score(self, hits: dict[tuple[int, int], list[float]]) -> float:
        plain, quoted = self.features(hits)
        b, p, q = self.coefficients
        return float(1 / (1 + np.exp(-np.clip(b + p * plain + q * quoted, -30, 30))))


def likelihood_ratio(a: int, b: int, positives: int, negatives: int) -> float:
    """The G statistic of a term in ``a`` of the toxic and ``b`` of the other documents."""
    total, out = positives + negatives, 0.0
    for seen, row, column in ((a, a + b, positives), (b, a + b, negatives), (positives - a, total - a - b, positives), (negatives - b, total - a - b, negatives)):
        if seen > 0:
            out += 2 * seen * np.log(seen * total / (row * column))
    return float(out)


def choose_terms(counts: dict[str, tuple[int, int]], positives: int, negatives: int, least: float = 2.0, most: int = 5000) -> list[str]:
    """Prefixes and whole words (with ``$``) that mark toxic documents, as specific as their documents allow, none under another.

    A term's log odds are at least ``least``, and so unlikely by chance that hardly one of all those that were looked at would be.
    """
    odds, sure = {}, 2 * np.log(max(1, len(counts))) + 2
    for p, (a, b) in counts.items():
        w = np.log((a + 0.5) / (positives + 1)) - np.log((b + 0.5) / (negatives + 1))
        if w >= least and likelihood_ratio(a, b, positives, negatives) >= sure:
            odds[p] = w
    closed = set(odds)
    for p in odds:
        if p[:-1] in closed and counts[p][0] >= 0.9 * counts[p[:-1]][0] and odds[p] >= odds[p[:-1]] - 0.7:
            closed.discard(p[:-1])
    out: set[str] = set()
    for p in sorted(closed, key=lambda p: (len(p), p)):
        above = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in out), None)
        if above is None:
            out.add(p)
        elif odds[p] > odds[above] + 1.5:
            out.add(p)
    return sorted(sorted(out, key=lambda p: (-odds[p], p))[:most])


def prefixes(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(QUOTED.sub(" ", text).lower())):
        out.update(w[:k] for k in STEM if k <= len(w))
        out.add(f"{w}{END}")
    return out


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, weights: np.ndarray | None = None) -> np.ndarray:
    """Logistic coefficients drawn to ``prior``, which holds where the sample says nothing; a row counts as many times as its weight says."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if weights is None else weights
    b = prior.astype(float).copy()

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + strength / 2 * ((b - prior) ** 2).sum())

    for _ in range(100):
        p = (1 + np.tanh(x @ b / 2)) / 2
        slope = x.T @ (w * (p - y)) + strength * (b - prior)
        step = -np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + strength * np.eye(3), slope)
        # whole steps overshoot where texts are far from the cut
        size, now = 1.0, loss(b)
        while loss(b + size * step) > now + 1e-4 * size * float(slope @ step) and size > 1e-9:
            size /= 2
        b += size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return b


def one_of_each_family(texts: DataFrame, bands: int = 24, picks: int = 3) -> list[tuple[int, int]]:
    """(_key, _y) of one text of each family of (near) copies, by class: texts that share a band's sample of shingles.

    For a table of bounded size, of which a row of ``bands`` numbers for each text goes to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [symbols(np.asarray(w, np.int64)) for w in batch["_w"]]
                yield pd.DataFrame({"_key": batch["_key"], "_y": batch["_y"], "_sigs": [order_minhash(f, bands, picks) if len(f) else [] for f in found]})

    rows = sorted(texts.select("_key", "_y", word_hashes(F.col("_t")).alias("_w")).mapInPandas(run, "_key long, _y int, _sigs array<long>").collect(), key=lambda r: (r._y, r._key))
    up, first = list(range(len(rows))), {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, r in enumerate(rows):
        for mark in [("", r._key), *enumerate(r._sigs)]:
            a, b = root(first.setdefault((r._y, *mark), i)), root(i)
            up[max(a, b)] = min(a, b)
    return [(r._key, r._y) for i, r in enumerate(rows) if root(i) == i]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> Model:
    """Learn from at most ``per_class`` labelled documents of each class, in a fixed order by hash.

    The coefficients are fitted with each class weighted by its count over all learnable labels, so that they
    don't depend on how many of it the sample holds.
    Held-out ids (see ``held_out``) are never learned from. Labels that repeat count once, as 1 if any is.
    Copies and near copies of a text in a class count as one.
    Null ids, labels and texts are skipped. Without a toxic label the model scores all low.
    What the lexicon may hold is bounded too: at most 5,000 terms (``choose_terms``), stems of 3 to 12 letters (``STEM``), longer ones as
    whole words; quotations of over 200 letters count as plain speech in learning (``QUOTED``). All texts are scored whole.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    order = F.xxhash64("_id", F.lit(11))
    sample = known.filter("_y = 1").orderBy(order, "_id").limit(per_class).unionByName(known.filter("_y = 0").orderBy(order, "_id").limit(per_class))
    # at most 2 * per_class rows of two numbers
    rows = [(r._id, int(r._y)) for r in sample.collect()]
    if not any(y for _, y in rows):
        return Model()
    # one row for each class
    counted = {r._y: r["count"] for r in known.filter("_y in (0, 1)").groupBy("_y").count().collect()}
    # a sample of the labels, of bounded size
    ids = docs.sparkSession.createDataFrame(rows, "_id long, _y int")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.make_valid_utf8(F.col(text_col)).alias("_t")).filter("_t is not null").join(F.broadcast(ids), "_id").select("_t", "_y")

    # read once; at most 2 * per_class documents
    scratch = Scratch(docs.sparkSession)
    texts = scratch.settle(texts.withColumn("_half", F.pmod(F.xxhash64("_t", F.lit(13)), F.lit(2)).cast("int")).withColumn("_key", F.xxhash64("_t")), "sample")
    # copies teach once: the words of a text that many toxic documents copy would all seem toxic
    kept = one_of_each_family(texts)
    texts = texts.dropDuplicates(["_key", "_y"]).join(F.broadcast(docs.sparkSession.createDataFrame(kept, "_key long, _y int")), ["_key", "_y"])
    taken = Counter(y for _, y in kept)
    share = np.array([counted.get(v, 0) / max(1, taken[v]) for v in (0, 1)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text, y, half in zip(batch["_t"], batch["_y"], batch["_half"], strict=True):
                found.update((p, y, half) for p in prefixes(text))
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["p", "y", "half", "n"])

    # a row for each prefix that marks at least a few toxic documents of the sample
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]
    counts = {r.p: np.array([[r.n00, r.n01], [r.n10, r.n11]]) for r in texts.mapInPandas(count, "p string, y int, half int, n long").groupBy("p").agg(*sums).filter("n10 + n11 >= 3").toLocalIterator()}
    sizes = np.zeros((2, 2), int)
    for r in texts.groupBy("_y", "_half").count().collect():
        sizes[r._y, r._half] = r["count"]
    # a lexicon from all of the sample, and one from each half for the other to try
    uses = {"all": np.array([1, 1]), "first": np.array([1, 0]), "second": np.array([0, 1])}
    lexicons = {k: choose_terms({p: (int(n[1] @ u), int(n[0] @ u)) for p, n in counts.items() if n[1] @ u >= max(3, sizes[1] @ u // 200)}, int(sizes[1] @ u), int(sizes[0] @ u)) for k, u in uses.items()}

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matchers = {k: Matcher(terms) for k, terms in lexicons.items()}
        for batch in batches:
            hits = {k: [[float(v) for m, n in matcher.hits(t).items() for v in (*m, *n)] for t in batch["_t"]] for k, matcher in matchers.items()}
            yield pd.DataFrame({"y": batch["_y"], "half": batch["_half"], **hits})

    # at most 2 * per_class rows with a few matches each
    found = list(texts.mapInPandas(match, "y int, half int, " + ", ".join(f"{k} array<double>" for k in uses)).toLocalIterator())
    hits = {k: [{(int(h[0]), int(h[1])): list(h[2:]) for h in zip(*[iter(r[k])] * 4, strict=True)} for r in found] for k in uses}
    scratch.drop()
    y, half = np.array([r.y for r in found], int), np.array([r.half for r in found], int)
    models = {k: Model(lexicons[k], weigh(lexicons[k], [h for h, side in zip(hits[k], half, strict=True) if u[side]], y[u[half] == 1])) for k, u in uses.items()}
    # the coefficients come from texts that the lexicon hasn't seen
    x = [models["second" if side == 0 else "first"].features(hits["second" if side == 0 else "first"][i]) for i, side in enumerate(half)]
    model = models["all"]
    model.coefficients = tuple(float(v) for v in fit(np.array(x).reshape(-1, 2), y.astype(float), np.array([-3.0, 1.0, 0.2]), weights=share[y]))
    return model


def weigh(terms: list[str], hits: list[dict[tuple[int, int], list[float]]], y: np.ndarray) -> dict[tuple[int, int], float]:
    """Log odds of each term at each distance, by plain occurrences; a misspelling that the sample lacks has half the weight of a whole word."""
    seen: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for h, v in zip(hits, y, strict=True):
        for m, (plain, quoted) in h.items():
            if plain > quoted:
                seen[m][v] += 1
    positives, negatives, out = int(y.sum()), int((1 - y).sum()), {}
    for i, term in enumerate(terms):
        for d in range(allowed(term) + 1):
            b, a = seen.get((i, d), (0, 0))
            w = float(np.log((a + 0.5) / (positives + 1)) - np.log((b + 0.5) / (negatives + 1)))
            exact = out.get((i, 0), 0.0)
            out[i, d] = max(0.0, w) if not d else (0.5 * exact if term.endswith(END) else 0.0) if not a + b else float(np.clip(w, 0, exact))
    return out


def score(model: Model, text: Column) -> Column:
    """The toxicity of a text, 0 to 1; a null text scores like an empty one; bytes that aren't UTF-8 count as replacement characters."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(model.terms)
        clean = model.score({})
        for batch in batches:
            yield pd.Series([model.score(h) if (h := matcher.hits(t)) else clean for t in batch])

    return run(readable(text))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null id is not held out. Rows that repeat are scored each; no rows in, no rows out."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class)
    scored = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), score(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
