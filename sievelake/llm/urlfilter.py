"""URL filter: host and path rules first, then gradient-boosted trees over lexical features.

The trees learn from labelled URLs: the caller's, or those that the rules decide. Rates by
suffix, site, host and first directory are counted over all of them and joined in. The trees are boosted
on the driver over a sample of bounded size, weighted by the labels' true counts, and score in batches.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words in a host, between dots, hyphens or digits, that can label a URL as unwanted where nobody has labelled any.
UNWANTED = ("ads", "adult", "bet", "bets", "betting", "casino", "cheap", "clickbait", "escort", "free", "gambling", "loan", "payday", "pharma", "pills", "poker", "porn", "sex", "slots", "spam", "track", "tracker", "viagra", "xxx")
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "query_chars", "hyphens", "host_hyphens", "upper", "https", "fragment", "extension", "percent", "longest_label", "suffix_rate", "site_rate", "host_rate", "first_dir_rate")
MIN_LEAF, BINS = 20, 32
RATES = FEATURES[-4:]
#: Of the rates for training: a URL's own fold is left out.
FOLDS, WEIGHT = 5, 10.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @classmethod
    def of(cls, text: str, verdict: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(host.translate(str.maketrans(UPPER, LOWER)), f"/{path}", verdict)


def parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lowered; path: then up to ``?``, ``#`` or end. Both are empty for null or no ``://``."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substr(rest, F.length(host) + 1)


def ruled(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null. The rules are a list of the caller's, so of bounded size."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: str) -> float:
    if not text:
        return 0.0
    n = np.fromiter(Counter(text).values(), float)
    return float(-(n / n.sum() * np.log2(n / n.sum())).sum())


def tail(host: str, n: int) -> str:
    return ".".join(host.split(".")[-n:])


def first_dir(path: str) -> str:
    return path.split("/")[1] if path.count("/") > 1 else ""


class Rates:
    """Smoothed rate of unwanted URLs by the host's last one, two and three labels and by first directory, from training URLs; unseen ones have the overall rate."""

    def __init__(self, hosts: list[str], paths: list[str], labels: np.ndarray, weight: float = 10.0):
        self.all = float(labels.mean()) if len(labels) else 0.5
        self.tables = []
        for keys in ([tail(h, 1) for h in hosts], [tail(h, 2) for h in hosts], [tail(h, 3) for h in hosts], [first_dir(p) for p in paths]):
            n, s = Counter(keys), Counter()
            for k, y in zip(keys, labels, strict=True):
                s[k] += y
            self.tables.append({k: (s[k] + weight * self.all) / (n[k] + weight) for k in n})

    def of(self, host: str, path: str) -> list[float]:
        return [t.get(k, self.all) for t, k in zip(self.tables, (tail(host, 1), tail(host, 2), tail(host, 3), first_dir(path)), strict=True)]


def features(urls: list[str | None], hosts: list[str], paths: list[str], rates: Rates) -> np.ndarray:
    return with_rates(urls, hosts, paths, np.asarray([rates.of(h, p) for h, p in zip(hosts, paths, strict=True)], float))


def with_rates(urls: list[str | None], hosts: list[str], paths: list[str], rates: np.ndarray) -> np.ndarray:
    """Lexical features, then the four rates of each URL."""
    rows = []
    for url, host, path in zip(urls, hosts, paths, strict=True):
        url = url or ""
        query = url.partition("?")[2].partition("#")[0]
        labels = host.split(".")
        rows.append([
            len(url), len(host), len(path), path.count("/"), len(labels), sum(c.isdigit() for c in url) / max(1, len(url)), sum(c.isdigit() for c in host), entropy(url), entropy(host),
            query.count("&") + bool(query), len(query), url.count("-"), host.count("-"), sum(c.isupper() for c in url), url.startswith("https"), "#" in url, bool(re.search(r"\.\w{1,5}$", path)), url.count("%"), max(map(len, labels)),
        ])
    return np.hstack([np.asarray(rows, float).reshape(-1, len(FEATURES) - len(RATES)), rates.reshape(-1, len(RATES))])


def unseen_features(urls: list[str], hosts: list[str], paths: list[str], y: np.ndarray, folds: int = 5) -> np.ndarray:
    """Features for training: the rates of a fold come from the others, or a host seen once would tell its own label."""
    out = np.empty((len(urls), len(FEATURES)))
    fold = np.arange(len(urls)) % folds
    for k in range(folds):
        rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        rates = Rates([hosts[i] for i in rest], [paths[i] for i in rest], y[rest])
        out[own] = features([urls[i] for i in own], [hosts[i] for i in own], [paths[i] for i in own], rates)
    return out


class BoostedTrees:
    """Binary log-loss boosting of shallow trees over binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.l2 = trees, depth, rate, l2
        self.base, self.grown = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> BoostedTrees:
        w = np.ones(len(y)) if weights is None else weights
        p = ((w * y).sum() + 1) / (w.sum() + 2)
        self.base, self.grown = float(np.log(p / (1 - p))), []
        if not len(y):
            return self
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, edges, w * (y - q), w * q * (1 - q), np.arange(len(y)), self.depth)
            self.grown.append(tree)
            score += self._score(tree, x)
        return self

    def _grow(self, binned, edges, g, h, rows, depth):
        leaf = float(self.rate * g[rows].sum() / (h[rows].sum() + self.l2))
        if not depth or len(rows) < 2 * MIN_LEAF:
            return leaf
        best, cut = 1e-6, None
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            n = np.bincount(b, minlength=len(e) + 1).cumsum()[:-1]
            lg, lh = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1], np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
            gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (total_h - lh + self.l2) - total_g**2 / (total_h + self.l2)
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
            at = int(gain.argmax())
            if gain[at] > best:
                best, cut = float(gain[at]), (f, at)
        if cut is None:
            return leaf
        left = binned[rows, cut[0]] <= cut[1]
        return (cut[0], float(edges[cut[0]][cut[1]]), self._grow(binned, edges, g, h, rows[left], depth - 1), self._grow(binned, edges, g, h, rows[~left], depth - 1))

    def _score(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, at, left, right = tree
        return np.where(x[:, f] <= at, self._score(left, x), self._score(right, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for t in self.grown:
            score += self._score(t, x)
        return 1 / (1 + np.exp(-score))


def labelled_by_words(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label) where nobody has labelled any URLs: block where the host has one of UNWANTED, else allow."""
    return urls.select(F.col(url_col).alias("url"), words_label(parts(F.col(url_col))[0]).alias("label"))


def words_label(host: Column) -> Column:
    return F.when(F.rlike(host, F.lit(rf"(^|[.\d-])({'|'.join(UNWANTED)})([.\d-]|$)")), "block").otherwise("allow")


def rate_keys(host: Column, path: Column) -> list[Column]:
    """The host's last one, two and three labels, and the first directory, as ``tail`` and ``first_dir`` give them."""
    folders = F.split(path, "/", -1)
    return [*(F.substring_index(host, ".", -n) for n in (1, 2, 3)), F.when(F.size(folders) > 2, F.get(folders, F.lit(1))).otherwise("")]


@dataclass(frozen=True)
class CountedRates:
    """What ``Rates`` holds, counted over all labelled URLs: a table of a row for each key, and the counts of URLs and unwanted ones in each fold."""

    table: DataFrame
    urls: list[int]
    unwanted: list[int]

    @classmethod
    def of(cls, known: DataFrame) -> CountedRates:
        """From distinct (host, path, y, fold)."""
        counts = [c for k in range(FOLDS) for c in (F.count_if(F.col("fold") == k).alias(f"n{k}"), F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("y"))), F.lit(0)).alias(f"s{k}"))]
        keys = F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate(rate_keys(F.col("host"), F.col("path")))])
        # a hot host is counted before the shuffle
        table = settle(known.select(F.explode(keys).alias("k"), "y", "fold").groupBy("k.kind", "k.key").agg(*counts), "url-rates")
        # one row: each URL has one first directory
        all_ = table.filter("kind = 3").agg(*[F.coalesce(F.sum(f"{c}{k}"), F.lit(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in "ns"]).first()
        return cls(table, [all_[f"n{k}"] for k in range(FOLDS)], [all_[f"s{k}"] for k in range(FOLDS)])

    def join(self, pages: DataFrame, fold: str | None = None, hide: bool = False) -> DataFrame:
        """``pages`` (host, path) with a column for each of RATES. Each row's own ``fold`` is left out, if given; with ``hide``, of every second row (url) all URLs of its host, as if it hadn't been seen."""
        total, bad = sum(self.urls), sum(self.unwanted)
        means = [(bad - s) / (total - n) if total > n else 0.5 for n, s in zip(self.urls, self.unwanted, strict=True)] if fold else [bad / total if total else 0.5]
        mean = F.get(F.array(*[F.lit(float(m)) for m in means]), F.col(fold) if fold else F.lit(0))
        for i, key in enumerate(rate_keys(F.col("host"), F.col("path"))):
            counts = self.table.filter(F.col("kind") == i).select(F.col("key").alias("_key"), F.array(*[f"n{k}" for k in range(FOLDS)]).alias("_n"), F.array(*[f"s{k}" for k in range(FOLDS)]).alias("_s"))
            pages = pages.withColumn("_key", key).join(counts, "_key", "left")
            n, s = (F.coalesce(sum((F.get(c, F.lit(k)) for k in range(FOLDS)), F.lit(0)) - (F.get(c, F.col(fold)) if fold else F.lit(0)), F.lit(0)) for c in ("_n", "_s"))
            pages = pages.withColumns({f"_n{i}": n, f"_s{i}": s}).drop("_key", "_n", "_s")
        unseen = F.pmod(F.xxhash64("url", F.lit(9)), F.lit(2)) == 0 if hide else F.lit(False)
        for i, name in enumerate(RATES):
            # the last three labels stand for the host
            n, s = (F.col(f"_{c}{i}") - (F.when(unseen, F.col(f"_{c}2")).otherwise(0) if i < 3 else 0) for c in "ns")
            pages = pages.withColumn(name, (s + WEIGHT * mean) / (n + WEIGHT))
        return pages.drop(*[f"_{c}{i}" for c in "ns" for i in range(len(RATES))])


def train(labelled: DataFrame, sample: int = 20_000) -> tuple[BoostedTrees, CountedRates]:
    """From (url, host, path, label); a URL with both labels counts as block.

    The rates are counted over all distinct URLs. Half of the sample have their own hosts' URLs left out of them, so
    that the trees learn what to make of a host that no label names. The trees learn from at most ``sample`` of them, half of
    each label, collected in a fixed order by hash and weighted so that each label has its true share.
    """
    labelled = labelled.withColumns({c: F.make_valid_utf8(F.col(c)) for c in ("url", "host", "path")})
    known = labelled.filter(F.col("label").isin("block", "allow")).groupBy("url", "host", "path").agg(F.max((F.col("label") == "block").cast("int")).alias("y"))
    known = settle(known.withColumn("fold", F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS)).cast("int")), "url-labels")
    rates = CountedRates.of(known)
    true = np.array([sum(rates.urls) - sum(rates.unwanted), sum(rates.unwanted)])
    # by hash, so that little more than the sample is sorted; with a margin of many standard deviations
    steps, order = 1 << 40, F.xxhash64("url")
    most = [int(steps * min(1.0, (1.2 * (sample // 2) + 100) / max(1, int(n)))) for n in true]
    picked = [known.filter((F.col("y") == y) & (F.pmod(order, F.lit(steps)) < most[y])).orderBy(F.pmod(order, F.lit(steps)), order, "url").limit(sample // 2) for y in (1, 0)]
    # at most ``sample`` rows
    rows = sorted(rates.join(settle(picked[0].unionByName(picked[1]), "url-sample"), "fold", hide=True).collect(), key=lambda r: (-r.y, r.url))
    y = np.array([r.y for r in rows], float)
    share = np.array([true[v] / true.sum() * len(y) / max(1, (y == v).sum()) for v in (0, 1)]) if len(y) else np.ones(2)
    x = with_rates([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], np.array([[r[c] for c in RATES] for r in rows], float))
    return BoostedTrees().fit(x, y, share[y.astype(int)]), rates


def filter_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None, sample: int = 20_000) -> DataFrame:
    """page_id, url, host, path, rule, verdict, score of every row.

    The longest fitting rule decides; a rule fits its host and all its subdomains if the path
    starts with the rule's. Otherwise the trees do: block at a score of 0.5 or more. They learn from
    ``labelled`` (url, label: block or allow), or else from the rows that a rule decides. Without any labelled URL all scores are 0, so the unruled are allowed. Null ids and urls
    stay; rows that repeat are judged each; urls of any length are taken whole; bytes that aren't UTF-8 count as replacement characters in features and stay as they are in the result.
    """
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")).withColumns(dict(zip(("host", "path"), parts(F.col("url")), strict=True)))
    name, verdict = ruled(rules, F.col("host"), F.col("path"))
    base = base.select("_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = base.withColumn("label", F.col("ruled"))
    else:
        labelled = labelled.select("url", "label").withColumns(dict(zip(("host", "path"), parts(F.col("url")), strict=True)))
    trees, rates = train(labelled.filter("label is not null and url is not null"), sample)
    known = bool(trees.grown)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = with_rates(*(batch[c].where(batch[c].notna(), None).tolist() for c in ("u", "h", "p")), batch[list(RATES)].to_numpy(float))
            yield batch.drop(columns=["u", "h", "p", *RATES]).assign(score=trees.predict(x) if known else 0.0)

    names = ("url", "host", "path")
    # what passes through goes as bytes, which needn't be UTF-8; features are of what Python can read
    rated = rates.join(base.withColumn("_id", F.col("_id").cast("string"))).withColumns({k: F.make_valid_utf8(F.col(c)) for k, c in zip("uhp", names, strict=True)}).withColumns({c: F.col(c).cast("binary") for c in names})
    scored = rated.mapInPandas(run, "_id string, url binary, host binary, path binary, rule string, ruled string, score double")
    return scored.select(F.col("_id").cast("long").alias(id_col), *[F.col(c).cast("string").alias(c) for c in names], "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
