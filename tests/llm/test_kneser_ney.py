"""The language model against a brute-force one, by both ways back to the documents."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import kneser_ney as kn


def grams(text, n):
    s = [0] * (kn.ORDER - 1) + [int(x) for x in kn._symbols(text)]
    return [tuple(s[i - n + 1:i + 1]) for i in range(kn.ORDER - 1, len(s))]


def brute(trusted):
    """p(w | h) as a function of the n-gram, by the textbook recursion."""
    counts = {kn.ORDER: Counter(g for t in trusted for g in grams(t, kn.ORDER))}
    for n in range(kn.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, context = {}, {}
    for n, c in counts.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        d = [(1 - 2 * y * k[2] / k[1]) if k[1] else 0.5, (2 - 3 * y * k[3] / k[2]) if k[2] else 1.0, (3 - 4 * y * k[4] / k[3]) if k[3] else 1.5]
        cut[n] = [0.0] + [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        context[n] = defaultdict(list)
        for g, x in c.items():
            context[n][g[:-1]].append(x)

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (kn.SYMBOLS - 1)
        seen = context[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        x, total = counts[n][g], sum(seen)
        mass = sum(cut[n][min(v, 3)] for v in seen)
        return (x - cut[n][min(x, 3)]) / total + mass / total * p(g[1:])

    return p


@pytest.mark.parametrize("broadcast_grams", [kn.BROADCAST_GRAMS, 0])
def test_scores_equal_brute_force(spark, broadcast_grams):
    rng = np.random.default_rng(5)
    words = ["the", "cat", "Sat", "mat,", "42", "été", "on", "a\n", "dog."]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(24)] + ["ZX## QQ%% 77!!", "", None, "x" * 3000]
    texts += texts[:2]
    rows = [(i, t, None if i % 5 == 0 else "en", 1.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, nll double")
    trusted = spark.createDataFrame([(i,) for i in range(16)], "doc_id long")
    fold = {r["doc_id"]: r["m"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).alias("m")).collect()}
    models = {m: brute([texts[i] for i in range(16) if fold[i] != m]) for m in (0, 1)}
    got = {r["id"]: r for r in kn.quality(df, trusted, broadcast_grams=broadcast_grams).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if not t:
            assert got[i]["perplexity"] is None and got[i]["keep"]
            continue
        nll = -sum(math.log(models[fold[i]](g)) for g in grams(t, kn.ORDER))
        assert got[i]["perplexity"] == pytest.approx(math.exp(nll / len(t)), rel=1e-4)
    assert all(got[i]["keep"] for i in range(16))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    one = spark.createDataFrame([(1,)], "doc_id long")
    assert kn.quality(df, one).count() == 0 and kn.keep_good(df, one).columns == df.columns


def test_symbols_tell_texts_apart(spark):
    # Case, digits, marks and letters of other scripts were of one class each.
    texts = ["aB", "aC", "a1", "a2", "aé", "ae", "я ты", "я мы", "日本", "日木", "a;", "a:", "€", "™"]
    assert len({tuple(kn._symbols(t)) for t in texts}) == len(texts)
    assert max(s for t in texts for s in kn._symbols(t)) < kn.SYMBOLS and 2 * kn.SYMBOLS ** kn.ORDER < 1 << 63
    good = ["кошка спит на тёплой печке", "собака лежит у старой двери"] * 20
    rows = [(i, t + " " * (i % 3), "ru") for i, t in enumerate(good)] + [(100, "щъфж эюёц жщъф цэюё щфъжц", "ru")]
    got = kn.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(40).toDF("doc_id"))
    assert {r["id"] for r in got.where("not keep").collect()} == {100}
