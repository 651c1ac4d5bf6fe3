import random
import zlib

import pytest

from sievelake.llm import toxicity
from sievelake.llm.toxicity import END, Automaton, Matcher, allowed, quotation, score_documents, train


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_distances():
    rng = random.Random(5)
    terms = ["moron$", "worthless$", "disgust", "scum$", "lowei", "idiot$"]
    a = Automaton(terms)
    letters = "abdeghilmnorstuw"
    words = ["moron", "moran", "worhtless", "wrthless", "disgusting", "disqusting", "scum", "scun", "loweischaft", "xloweia", "idiots"]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 10))) for _ in range(500)]
    for t in terms:
        for _ in range(60):
            w = list(t.rstrip(END) + rng.choice(["", "en"]))
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
            words.append("".join(w))
    for w in words:
        want = {}
        for i, t in enumerate(terms):
            plain = t.rstrip(END)
            d = distance(plain, w) if t.endswith(END) else min(distance(plain, w[:k]) for k in range(len(w) + 1))
            if d <= allowed(t):
                want[i] = d
        nearest = min(want.values(), default=0)
        assert a.match(w) == sorted((i, d) for i, d in want.items() if d == nearest), w


@pytest.mark.parametrize("text,q", [('he wrote "you moron there" again', 1.0), ("“what a moron” they yelled", 1.0), ("she called him moron once", 0.5), ("you are a moron", 0.0), ('an unclosed " you moron', 0.0), ('"moron" is a word', 1.0)])
def test_quotation(text, q):
    chunks = text.split()
    at = next(i for i, c in enumerate(chunks) if "moron" in c)
    assert quotation(chunks, at) == q


def corpus(spark, n=600):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(6))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(40)], i % 4 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["worthless", "disgusting", "pathetic"])
        elif i % 4 == 1:
            words[7:8] = ["they", "said", '"what', "a", rng.choice(["worthless", "disgusting"]), 'thing"', "then"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_quoted_terms_are_told_from_abuse_and_misspelled_ones_are_caught(spark):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_documents(docs, labels).collect()
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out]
    assert len(out) > 60 and sum(a == b for a, b in out) / len(out) > 0.95
    model = train(docs, labels)
    m = Matcher(model.terms)
    high, low = model.score(m.hits("you wortless disgustin thing")), model.score(m.hits("a calm text"))
    assert high > 0.5 > low


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_documents(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in out) / len(out) > 0.9


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(spark, 200)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert train(docs, labels) == train(docs, flipped)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, None), (3, 0), (3, 1), (None, 1), (99, 0)], "doc_id long, toxic int")
    rows = score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert score_documents(none, labels).collect() == [] and len(score_documents(odd, labels.limit(0)).collect()) == odd.count()


def test_a_bounded_sample_keeps_the_rate_of_false_positives(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(4000):
        words, toxic = ["".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(8)], i % 25 == 0
        # a word of most toxic documents, but of more clean ones
        if rng.random() < (0.8 if toxic else 0.07):
            words[rng.randrange(8)] = "rubbish"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rates = {}
    for per_class in (80, 4000):
        model = train(docs, labels, per_class=per_class)
        assert any(t.startswith("rub") for t in model.terms)
        rows = score_documents(docs, labels, per_class=per_class).filter("held_out and doc_id % 25 > 0").collect()
        rates[per_class] = sum(r.predicted for r in rows) / len(rows)
    assert rates[80] <= rates[4000] + 0.01, rates
