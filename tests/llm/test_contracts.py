"""Operators against plain versions: fingerprints, archives, budgets, places."""
import base64
import hashlib
import math
import re
import struct
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pulseframe.llm import bpe, hilbert, imatch, kneser_ney, licences, linededup, mixing, prefixjoin, queries, warc


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _xx(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed=seed)
    return _signed(seed)


def _plain_fingerprint(text, lex):
    ts = {w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w}
    s0 = sorted(h for h in (_xx([t.encode()]) for t in ts) if h in lex)
    if not s0:
        return None, _xx([text.encode()])
    out = [s0]
    for level in range(1, imatch.LEVELS + 1):
        for f in range(imatch.FAMILIES):
            mask = 4 ** (level + 1) - 1
            out.append([h for h in s0 if _xx([struct.pack("<q", h), struct.pack("<i", imatch.SEED * imatch.FAMILIES + f)]) & mask == 0])
    return [_xx([struct.pack("<q", h) for h in s]) if s else None for s in out], None


def _plain_likeness(a, b):
    if a[1] is not None or b[1] is not None:
        return float(a[1] == b[1])
    pairs = [(x, y) for x, y in zip(a[0], b[0]) if x is not None or y is not None]
    return sum(x == y for x, y in pairs) / len(pairs)


def _spelled(fp):
    show = lambda h: "%x" % (h & (1 << 64) - 1)
    return "text-" + show(fp[1]) if fp[0] is None else ".".join("-" if h is None else show(h) for h in fp[0])


def test_imatch_query_against_plain_version(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(60)]
    texts += [None, "", "  ", " " + texts[3], texts[4], "only here", texts[4] + "\n"]
    rows = [(2 * i + 1, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_imatch(spark, str(tmp_path)).collect()}
    plain = [t or "" for t in texts]
    df = {}
    for t in plain:
        for w in {w for w in t.lower().split() if w}:
            df[w] = df.get(w, 0) + 1
    n = len(plain)
    lex = {_xx([w.encode()]) for w, c in df.items() if imatch.MIN_IDF <= math.log(n / c) <= imatch.MAX_IDF}
    assert len(got) == n
    fps = [_plain_fingerprint(t, lex) for t in plain]
    for i, t in enumerate(plain):
        k, after = len(t) // 4, plain[(i + 1) % n]
        edited = t[:len(t) - k] + after[:k]
        e, r = _plain_fingerprint(edited, lex), got[2 * i + 1]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (_spelled(fps[i]), _spelled(e))
        assert r["near_edited"] == pytest.approx(_plain_likeness(fps[i], e))
        assert r["near_next"] == pytest.approx(_plain_likeness(fps[i], fps[(i + 1) % n]))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none/documents.parquet"))
    assert queries.op1_imatch(spark, str(tmp_path / "none")).count() == 0


def test_imatch_families_are_independent(spark):
    hashes = [_xx([str(i).encode()]) for i in range(4000)]
    kept = [{h for h in hashes if _xx([struct.pack("<q", h), struct.pack("<i", imatch.SEED * imatch.FAMILIES + f)]) & 15 == 0} for f in range(imatch.FAMILIES)]
    assert all(150 < len(k) < 350 for k in kept)
    assert all(len(a & b) < 60 for i, a in enumerate(kept) for b in kept[:i])


def _plain_lines(rows):
    """Rows (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines, cover = (t or "").split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            cover |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in cover) if cover else t, len(lines), len(cover))
    return out


def test_line_windows_against_plain_version(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice(list("abcd"), rng.integers(0, 12)))) for i in range(60)] + [(60, None), (61, "a"), (62, "")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_lines int, _id string, _covered int")
    got = linededup.dedup_lines(df)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in got.collect()} == _plain_lines(rows)
    assert got.columns.count("n_lines") == 1 and got.columns[:4] == ["doc_id", "text", "_id", "_covered"]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_line_windows_of_very_many_equal_lines(spark):
    df = spark.createDataFrame([(1, "same\n" * 100_000)], "doc_id long, text string")
    r = linededup.dedup_lines(df).first()
    assert (r["n_lines"], r["n_removed"], r["text"]) == (100_001, 99_999, "same\n")


def test_line_windows_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")] * 2 + [(2, "a\nb\nc"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(df).where("doc_id is not null").collect()) == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]


def test_archives_against_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), f"http://x/{i}", str(rng.choice(["", "p", "q" * 3000, "é"])) if i % 3 else f"own {i}") for i in rng.permutation(200)]
    rows += [(500, None, None), (None, "u", "p"), (None, "v", "p"), (None, "v", "alone"), (None, None, None), (None, "a", "twin"), (None, "b", "twin")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = sorted(((r["id"] is None, r["id"] or 0, r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        p, to = (h or "").encode(), largest.get(h or "")
        own = to is None or to == i
        want.append((i is None, i or 0, base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), "response" if own else "revisit", None if own else to))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def _plain_mix(docs, levels, budget, weights, epochs, seed):
    """docs: dicts with the levels, id and n. Returns the taken (id, epoch)s."""
    total = sum(d["n"] for d in docs)
    w = lambda name, v: Fraction(weights.get(name, {}).get(v, 1))
    leaves = {}
    for d in docs:
        leaves.setdefault(tuple(d[k] for k in levels), []).append(d)
    caps = {p: epochs * sum(d["n"] for d in ds) for p, ds in leaves.items() if all(w(k, v) > 0 for k, v in zip(levels, p))}
    given = {}

    def fill(prefix, amount):
        depth = len(prefix)
        if depth == len(levels):
            given[prefix] = amount
            return
        kids = {}
        for p, c in caps.items():
            if p[:depth] == prefix:
                kids[p[:depth + 1]] = kids.get(p[:depth + 1], 0) + c
        got, open_ = {}, set(kids)
        while open_:
            rate = (amount - sum(got.values())) / sum(w(levels[depth], k[-1]) for k in open_)
            full = [k for k in open_ if kids[k] <= rate * w(levels[depth], k[-1])]
            if not full:
                got.update({k: rate * w(levels[depth], k[-1]) for k in open_})
                break
            got.update({k: kids[k] for k in full})
            open_ -= set(full)
        for k, x in got.items():
            fill(k, x)

    fill((), Fraction(budget) * total)
    out = []
    for p, amount in given.items():
        rest, ds = math.floor(amount), leaves[p]
        size = sum(d["n"] for d in ds)
        if not size:
            continue
        full, rest = divmod(rest, size)
        key = lambda d: (hashlib.md5(f"{seed}-{full}-{d['id']}".encode()).hexdigest(), d["id"])
        out += [(d["id"], e) for d in ds for e in range(full)]
        used = 0
        for d in sorted(ds, key=key):
            used += d["n"]
            if used > rest:
                break
            if rest:
                out.append((d["id"], full))
    return sorted(out)


@pytest.mark.parametrize("budget", [0.25, 0.5, 2, 8])
def test_mix_of_three_levels_against_plain_version(spark, budget):
    rng = np.random.default_rng(6)
    docs = [{"d": str(rng.choice(["web", "book"])), "l": [None, "en", "fr"][rng.integers(3)], "s": f"s{rng.integers(3)}", "id": i, "n": int(rng.integers(0, 40))}
            for i in range(150)]
    weights = {"d": {"web": 0.75, "book": 0.25}, "l": {"fr": 0.0, "en": 2.0}, "s": {"s0": 0.5, "s1": 0.25, "s2": 0.25}}
    df = spark.createDataFrame([(x["id"], x["d"], x["l"], x["s"], x["n"], "a", "b", 1, 2) for x in docs],
                               "doc_id long, d string, l string, s string, n long, _k string, leaf string, tokens int, epoch int")
    out = mixing.mix(df, {k: F.col(k) for k in "dls"}, F.col("n"), budget, weights, epochs=4)
    assert sorted((r["doc_id"], r["epoch"]) for r in out.collect()) == _plain_mix(docs, "dls", budget, weights, 4, 17)
    assert out.columns == ["doc_id", "d", "l", "s", "n", "_k", "leaf", "tokens", "epoch"]


def test_mix_gives_a_zero_weight_shortage_to_the_others(spark):
    rows = [(i, "a", "x" if i % 2 else "y", 10) for i in range(20)] + [(100 + i, "b", "x", 10) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, d string, l string, n long")
    out = mixing.mix(df, {"d": F.col("d"), "l": F.col("l")}, F.col("n"), 2.5, {"l": {"y": 0.0}}, epochs=4)
    got = {r["d"]: r["t"] for r in out.groupBy("d").agg(F.sum("tokens").alias("t")).collect()}
    assert got == {"a": 400, "b": 600}


def test_mix_counts_words(spark):
    texts = [None, "", " \n\t ", "\none two\n", "x", " a  b c "]
    df = spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(texts)] * 2, "doc_id long, text string, lang string, source string")
    got = {(r["doc_id"], r["tokens"]) for r in queries.mixed(df.union(df)).collect()}
    assert got <= {(0, 0), (1, 0), (2, 0), (3, 2), (4, 1), (5, 3)} and {3, 4, 5} & {i for i, _ in got}


def test_a_licence_at_any_word_is_one_place(spark):
    names = ["MIT-disclaimer", "Apache-2.0", "BSD-conditions"]
    cases = [(n, k) for n in names for k in range(0, 130, 7)]
    rows = [(i, "zz " * k + licences.TEMPLATES[n] + " yy" * 50) for i, (n, k) in enumerate(cases)]
    got = {}
    for r in licences.licence_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r["id"], r["licence"]), []).append(r["first_word"])
    assert {i: got.get((i, n)) for i, (n, _) in enumerate(cases)} == {i: [k] for i, (_, k) in enumerate(cases)}


def test_frequent_words_are_cut_by_count(spark):
    text = " ".join(["often"] * 9000 + ["seen"] * 5000 + ["some"] * 40 + ["other"] * 40 + ["rare"] * 2 + ["once"])
    df = spark.createDataFrame([(text,), (None,)], "text string")
    assert bpe.frequent_words(df, "text", 10) == ["often", "other", "rare", "seen", "some"]
    assert bpe.frequent_words(df, "text", 3) == ["often", "seen"]
    assert bpe.frequent_words(df.limit(0), "text", 3) == []


def test_cosines_of_huge_and_tiny_components():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(50, 8)), rng.normal(size=8)
    want = hilbert.cosines(x, q)
    assert (hilbert.cosines(x * 2.0 ** 900, q * 2.0 ** -900) == want).all()
    assert hilbert.cosines(np.array([[1e200, 1e200], [1e300, 0]]), np.array([1e200, 1e200])) == pytest.approx([1, 0.5 ** 0.5])


def test_quality_decides_for_each_text_of_an_id(spark):
    good = ["the cat sat on the mat and the dog ran to the house again"] * 30
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(3, "ZX## QQ%% !!JJ ##KK &&VV %%XX", "en"), (None, good[0], "en"), (None, "ZX## QQ%% !!JJ ##KK &&VV %%XX", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sure = spark.createDataFrame([(i,) for i in range(10, 30)], "doc_id long")
    kept = kneser_ney.keep_good(df, sure).collect()
    assert len(kept) == 31 and {r["text"] for r in kept} == {good[0]}


def _plain_components(rows):
    """{(id, text): (set size, least id of the component, its number)} of distinct rows."""
    rows = list(dict.fromkeys((i, t or "") for i, t in rows))
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return {r: (len(s), least.get(c), c) for r, s, c in zip(rows, sets, comp)}


@pytest.mark.parametrize("rounds,pairs_a_row", [(6, 0.1), (1, 3), (0, 8), (2, 32)])
def test_prefix_join_of_crowds_against_plain_version(spark, rounds, pairs_a_row):
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for c in range(4):  # crowds around a text, with distances on both sides of the limit
        base = [f"c{c}-{i}" for i in range(60)]
        for _ in range(25):
            v = list(base)
            for k in rng.choice(60, rng.integers(0, 5), replace=False):
                v[k] = f"n{rng.integers(1000)}"
            rows.append((len(rows), " ".join(v)))
    for _ in range(30):  # a shared passage in texts that don't link
        rows.append((len(rows), " ".join(passage + [f"o{rng.integers(10 ** 6)}" for _ in range(rng.integers(5, 15))])))
    base = " ".join(f"z{i}" for i in range(20))
    rows += [(1000, "some other text of words"), (1000, base), (1001, base.upper()), (1001, base.upper()), (None, base), (None, "no id here at all"),
             (None, "no id here at all"), (None, None), (1002, ""), (1003, None), (1004, "a b"), (1005, "A\tB")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, key int")
    got = prefixjoin.near_duplicates(df, sketch_bits=17, rounds=rounds, pairs_a_row=pairs_a_row)
    back = df.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct()
    got = got.join(back, got.id.eqNullSafe(back.doc_id) & (got.t == back.t)).select("doc_id", "text", "n_shingles", "component_id").collect()
    want = {k: (n, k[0] if n == 0 else c) for k, (n, c, _) in _plain_components(rows).items()}
    assert len(got) == len(want) and {(r["doc_id"], r["text"]): (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) > 20


def test_prefix_join_of_an_empty_table(spark):
    assert prefixjoin.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), sketch_bits=17).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Null and shared ids, repeated rows; every stage from its own input."""
    import corpus_pipeline as cp
    rng = np.random.default_rng(21)
    vocab = "the cat sat on mat and dog ran to house again red big old new bird tree lake".split()
    rows = [(i, "\n".join(" ".join(rng.choice(vocab, 12)) for _ in range(6))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(10)] + [(None, rows[20][1]), (None, rows[20][1] + " x"), (5, rows[30][1]), (40, rows[40][1]), (41, "")]
    rows += [(5, "ZX## QQ%% !!JJ ##KK &&VV %%XX " * 4), (None, "ZX## QQ%% !!JJ ##KK &&VV %%XX " * 4), (42, None), (42, None)]
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 4}", len(t or ""), "extra") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _id string")
    path = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(60) if i != 5], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good = cp.quality_stage(spark, docs, path)
    assert good.columns == cp.COLUMNS and pairs(good) == sorted((r for r in rows if "ZX" not in (r[1] or "")), key=str)
    lines = cp.line_stage(spark, docs.where("doc_id >= 6 and doc_id not in (40, 41, 42)"), path)
    plain = _plain_lines([r for r in rows if r[0] is not None and r[0] >= 6 and r[0] not in (40, 41, 42)])
    assert pairs(lines) == sorted(((i, t) for i, (t, _, gone) in plain.items() if t or not gone), key=str)
    kept = cp.near_duplicate_stage(spark, docs, path)
    comps = {}
    for (i, t), (n, _, c) in _plain_components(rows).items():
        if n:
            comps.setdefault(c, []).append((i is None, i or 0, t))
    single = [t for i, t in rows if not (t or "").split()]
    got = pairs(kept)
    assert len([t for _, t in got if not (t or "").split()]) == len(single) and len(got) == len(single) + len(comps)
    assert sorted(str(min(v)[:2]) for v in comps.values()) == sorted(str((i is None, i or 0)) for i, t in got if (t or "").split())
    mixed = cp.mixing_stage(spark, docs, path)
    assert mixed.columns == cp.COLUMNS and set(pairs(mixed)) <= set(rows)
    from tokenizers import Tokenizer
    import public_tokenizers
    lib = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    ids = sorted((r["doc_id"] or -1, r["ids"]) for r in cp.encoding_stage(spark, docs, path).collect())
    assert ids == sorted((i or -1, lib.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
