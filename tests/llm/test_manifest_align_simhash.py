import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import align, merkle, queries, simhash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, grp string, fp long, pairs string, n_a int"


def table(spark, rows):
    """(doc_id, text, lang) with columns that clash with internal names."""
    return spark.createDataFrame([(i, t, g, "s1", None if t is None else len(t), "x", "y", 7, "z", 0) for i, t, g in rows], COLUMNS)


# Merkle manifest

def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """Root of a list of digests, and every leaf's levels of (run, place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k:k + 8] for k in range(0, len(nodes), 8)]
        for k, p in enumerate(at):
            paths[k].append((runs[p // 8], p % 8))
        at, nodes = [p // 8 for p in at], [h(r) for r in runs]
    return nodes[0], paths


def brute_manifest(rows):
    """doc_id -> result columns; (doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], h(map(field, r)), r))
    trees = {}
    for g, x in groups.items():
        x.sort(key=lambda y: ((y[0] is not None, y[0] or 0), y[1]))
        trees[g] = climb([leaf for _, leaf, _ in x])
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for (i, leaf, r), path in zip(groups[g], trees[g][1]):
            levels = path + top
            shown = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                shown = h(map(field, (*r[:4], None if r[4] is None else re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))))
            proof = h(s for run, j in levels for k, s in enumerate(run) if k != j)
            for run, j in levels:
                shown = h([*run[:j], shown, *run[j + 1:]])
            out.append((i, leaf, trees[g][0], root, proof, shown, shown == root))
    return out


def manifest_rows(spark, rows, height):
    df = table(spark, rows)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_hash(*(queries.lower_ascii(f) if f == "text" else F.col(f) for f in queries.MANIFEST_FIELDS)))
    m = merkle.manifest(df, "lang", "doc_id", queries.MANIFEST_FIELDS, {"changed": changed}, height)
    return m, [tuple(r) for r in merkle.proofs(m, F.col("changed"), ["id"]).collect()]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_against_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice([None, "", "Plain Text", "ÀB c", "low", "x" * 3000]) if i % 5 else f"Doc {i}", rng.choice(["en"] * 9 + ["fr", None, "", "zz"]))
            for i in rng.sample(range(1000), 700)]
    rows += [(None, "No id", "en"), (None, None, None), (5, "again", "en"), (5, "again", "en"), (5, "Other", "en"), (7, "alone", "single")]
    _, got = manifest_rows(spark, rows, height)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = brute_manifest([(i, "s1", g, None if t is None else len(t), t) for i, t, g in rows])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_manifest_small_tables_and_files(spark, tmp_path):
    assert manifest_rows(spark, [], 3)[1] == []
    m, got = manifest_rows(spark, [(1, "Only", None)], 3)
    assert got[0][1] == got[0][2] == got[0][3]
    merkle.save(m, str(tmp_path / "m"))
    again = merkle.load(spark, str(tmp_path / "m"))
    assert [tuple(r) for r in merkle.proofs(again, F.lit(None).cast("binary"), ["id"]).collect()][0][:5] == got[0][:5]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_halves_the_height(levels):
    places = [np.asarray(merkle.address(levels, d, np.arange(8 ** d))) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(merkle.subtree_size(levels)))
    # The top half of the height comes first, then whole subtrees in order.
    top = levels // 2
    if top:
        assert max(p.max() for p in places[:top]) == merkle.subtree_size(top) - 1
        bottom = merkle.subtree_size(levels - top)
        for d in range(top, levels):
            assert ((places[d] - merkle.subtree_size(top)) // bottom == np.arange(8 ** d) >> 3 * (d - top)).all()


# Alignment of two tokenizers

def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, names = align.byte_letters(), {i: t for t, i in tok.get_vocab().items()}
    rows, counts = [], {}
    for t in texts:
        a = tok.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        ta = [bytes(letters[c] for c in names[i]) for i in a]
        tb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if not t or b"".join(ta) != (" " + t).encode() or b"".join(tb) != (" " + t).encode():
            rows.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in (ta, tb)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for c in common:
            groups.append(tuple(",".join(str(k) for k, e in zip(ids, es) if lo < e <= c) for ids, es in zip((a, b), ends)))
            lo = c
        rows.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
        for p in rows[-1][3]:
            counts[p] = counts.get(p, 0) + 1
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(len(a), len(b), len(g), len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p),
             hashlib.sha256(";".join(map("|".join, g)).encode()).hexdigest() if g else "") for a, b, g, p in rows]


ODD = [None, "", " ", "  ", "a", "the cat sat", " lead", "trail ", "two  spaces", "tab\there", "line\nend\n\n next", "café ﬁ é ñandú", "日本語 text 🙂", "x▁y",
       "<|endoftext|> b<s>", "</s><0x41><unk>", "don't we'll IT'S", "a  b", "a\x1c b", "　wide  em", "x" * 500, "né " * 40, "1234567 89.5%, (and)", "a\x00b", " \n x \n",
       "same same", "same same", "end.\n \nnext", "  sep"]


@pytest.mark.parametrize("sent", [10, 1_000_000])
def test_alignment_against_brute_force(spark, sent):
    rng = random.Random(1)
    glyphs = ["ab", "the", "é", " ", "  ", "\n", "\t", "🙂", "12", ",", "'s", " ", "▁", "Ing", "ß", "\x1d", "<0x0A>", "-", "\r\n", "語"]
    texts = ODD + ["".join(rng.choice(glyphs) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = table(spark, [(i, t, "en") for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r)[1:] for r in align.scored(df, A, B, ["doc_id"], sent_pairs=sent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_alignment(texts)


def test_alignment_tables(spark):
    rows = align.align_texts(table(spark, [(1, "the cat", "en"), (None, None, None)]), A, B).orderBy("doc_id").collect()
    assert rows[0]["groups"] == "" and rows[0]["pairs"] == [] and rows[0]["lang"] is None
    assert rows[1]["groups"].count(";") == 1 and rows[1]["n_links"] == 2 and sum(rows[1]["times"]) == 2
    assert align.scored(table(spark, []), A, B, ["doc_id"]).count() == 0


def test_alignment_groups_and_links():
    assert [x.tolist() for x in align.align([2, 3, 6], [3, 4, 6])] == [[2, 3], [1, 3]]
    i, j = align.links_of(np.array([2, 5, 6]), np.array([1, 3, 6]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]


# SimHash

def brute_fingerprint(text):
    from xxhash import xxh64_intdigest
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hs = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hs) > len(hs))


def brute_components(fps, distance):
    n = len(fps)
    x = np.array(fps, np.uint64)
    comp = np.arange(n)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= distance
    while True:
        new = np.array([comp[near[i]].min() for i in range(n)])
        if (new == comp).all():
            return comp
        comp = new


def test_simhash_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(300)) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "one TWO three", "Été été a b", "x " * 20000, "aa bb cc " * 900]
    for b in base:
        w = b.split()
        for k in range(12):
            v = list(w)
            for _ in range(k % 4):
                v[rng.randrange(300)] = "new"
            texts.append(" ".join(v))
    out = {r["id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(table(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i][0] & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [out[i][1] for i in range(len(texts))] == brute_components(fps, 3).tolist()


@pytest.mark.parametrize("distance,crowd", [(3, 64), (3, 2), (2, 2), (1, 2), (0, 2), (3, 1)])
def test_links_give_all_components(spark, distance, crowd):
    rng = np.random.default_rng(distance * 10 + crowd)
    centres = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    fps = {0}
    for c in centres:
        for _ in range(60):
            bits = rng.choice(64, rng.integers(0, 9), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in bits))
    fps |= {int(x) for x in rng.integers(0, 1 << 64, 300, dtype=np.uint64)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance, crowd).collect()
    at = {x: k for k, x in enumerate(signed)}
    comp = np.arange(len(fps))
    assert all(bin(r["a"] & (1 << 64) - 1 ^ r["b"] & (1 << 64) - 1).count("1") <= distance for r in found)
    for _ in range(len(fps)):
        old = comp.copy()
        for r in found:
            a, b = at[r["a"]], at[r["b"]]
            comp[a] = comp[b] = min(comp[a], comp[b])
        if (old == comp).all():
            break
    assert comp.tolist() == brute_components(fps, distance).tolist()


def test_allotments_spend_all_units():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 64, 500, dtype=np.uint64).view(np.int64)
    octets = np.stack([np.bincount(o, minlength=256) for o in fps.view(np.uint8).reshape(-1, 8).T]).astype(float)
    for m in simhash.PARTITIONS:
        costs = simhash.Costs(m, octets, 3)
        crowds = np.zeros((500, m))
        crowds[:250, 0] = 1e6
        t, cost = costs.allot(fps, crowds)
        assert ((t + 1).sum(axis=1) == 4).all() and (t[:250, 0] == -1).all() and np.isfinite(cost).all()


def test_bits_that_go_together_share_an_octet():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (4000, 64))
    for k in (9, 30, 63):
        bits[:, k] = bits[:, 2]
    both = bits.T @ bits
    order = simhash.bit_order(4000, both)
    assert sorted(order) == list(range(64)) and {2, 9, 30, 63} <= set(order[:8])


def test_simhash_ids(spark):
    rows = [(None, "a b c d", "en"), (9, "a b c d", "en"), (9, "a b c d", "en"), (None, "quite other words here now", "en")]
    got = sorted(((r["id"], r["component_id"]) for r in simhash.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 9), (9, 9), (9, 9), (None, None)], key=str)
    assert simhash.near_duplicates(table(spark, [])).count() == 0
