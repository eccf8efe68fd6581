import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import bpe, encode, hilbert, kneser_ney, licences, linededup, mixing, prefixjoin, repair, warc

TOK = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", "x") for i, t in enumerate(texts)], DOCS)


def test_prefix_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghij"), 60)) for _ in range(6)]
    texts = [None, "", "one two", "ONE two", "x y z w v"] + base
    for b in base[:3]:
        w = b.split()
        for k in range(4):
            v = list(w)
            v[10 * k] = "new"
            texts.append(" ".join(v))
    got = {r["id"]: r["component_id"] for r in prefixjoin.near_duplicates(docs(spark, texts), sketch_bits=17).collect()}
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert got == dict(enumerate(comp))


def test_encoder_equals_library_and_decodes(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(TOK)
    texts = ["", None, "The the IT'S café 12!!", "a<|endoftext|>b", "x" * 300, "Σας \x1c ½ 日本", "the the"]
    rows = encode.decode(encode.encode(docs(spark, texts), TOK), TOK).orderBy("doc_id").collect()
    for t, r in zip(texts, rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, lib.decode(ids, skip_special_tokens=False))
    assert encode.encode(docs(spark, []), TOK).count() == 0


def test_special_names_in_other_case_are_plain_text(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(TOK)
    names = ["<|ENDOFTEXT|>b", "<|EndOfText|>Hello", "A<|endofText|>b", "<|ENDOFTEXT|>", "<|ENDOFTEXT|>b<|endoftext|>C", "<|endoftext|>Hello",
             "<|StartOfText|>x", "<|STARTOFTEXT|>!"]
    texts = [*names, " ".join(names), "plain Words " + " ".join(reversed(names))]
    spec = open(TOK, encoding="utf-8").read()
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (bpe.Codec(spec, bpe.lexicon_file(bpe.Rules(spec), ["hello"])), repair.LibraryEncoder(spec)):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_lexicon_shares_suffixes():
    words = {b"testing": [1], b"resting": [2, 3], b"test": [4]}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    assert (lex.numbers([b"resting", b"test", b"tes", b"", b"zzz"]) >= 0).tolist() == [True, True, False, False, False]
    assert len(lex.final) < sum(map(len, words))


def test_grammar_round_trip_and_random_access():
    ids = np.tile(np.array([5, 6, 7, 7, 7, 8], np.uint32), 500)
    seq, rules = repair.compress(ids, 100)
    assert len(seq) < len(ids) and (repair.expand(seq, rules, 100) == ids).all()
    assert repair.rule_lengths(rules, 100).min() >= 2


def plain_pairs(ids):
    """Occurrences without overlap of every adjacent pair, left to right."""
    last, count = {}, {}
    for i, pair in enumerate(zip(ids, ids[1:])):
        if last.get(pair, -2) < i - 1:
            last[pair], count[pair] = i, count.get(pair, 0) + 1
    return count


@pytest.mark.parametrize("ids", [np.zeros(10_000), np.tile([5, 6], 4_000), np.random.default_rng(1).integers(0, 5, 8_000),
                                 np.tile(np.random.default_rng(2).integers(0, 60, 97), 90), np.random.default_rng(3).zipf(1.4, 20_000) % 200,
                                 np.arange(3), np.zeros(0)], ids=["zeros", "two", "five", "passage", "zipf", "three", "empty"])
def test_grammar_leaves_no_frequent_pair(ids):
    ids = ids.astype(np.uint32)
    seq, rules = repair.compress(ids, 200)
    assert (repair.expand(seq, rules, 200) == ids).all()
    assert max(plain_pairs(seq.tolist()).values(), default=0) < repair.LEAST_COUNT
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    # Every rule stands for an earlier pair, and its length is that of its expansion.
    lens = repair.rule_lengths(rules, 200)
    for k in range(len(rules)):
        assert rules[k].max() < 200 + k
        assert len(repair.expand(np.array([200 + k], np.uint32), rules, 200)) == lens[k]


def plain_grammar(ids, size):
    """Rounds over all places: of overlapping frequent pairs the more frequent one stays, ties go to the smaller."""
    seq, rules = ids.tolist(), []
    while True:
        count = {p: n for p, n in plain_pairs(seq).items() if n >= repair.LEAST_COUNT}
        at, last = [], {}
        for i, pair in enumerate(zip(seq, seq[1:])):
            if last.get(pair, -2) < i - 1:
                last[pair] = i
                at += [(-count[pair], pair, i)] if pair in count else []
        taken = {}
        for _, pair, i in sorted(at):
            if i - 1 not in taken and i + 1 not in taken:
                taken[i] = pair
        kept = [p for p in sorted(count) if sum(q == p for q in taken.values()) >= repair.LEAST_COUNT]
        if not kept:
            return seq, rules
        number = {p: size + len(rules) + k for k, p in enumerate(kept)}
        rules += kept
        taken = {i: p for i, p in taken.items() if p in number}
        seq = [number[taken[i]] if i in taken else x for i, x in enumerate(seq) if i - 1 not in taken]


def test_grammar_against_plain_rounds():
    rng = np.random.default_rng(6)
    cases = [np.repeat(rng.integers(0, 4, 400), rng.integers(1, 7, 400)) for _ in range(12)]  # runs of one symbol
    cases += [rng.integers(0, 3, 1_500), rng.zipf(1.5, 4_000) % 50, np.tile(rng.integers(0, 30, 41), 40)]
    for ids in cases:
        seq, rules = repair.compress(ids.astype(np.uint32), 50)
        want, made = plain_grammar(ids, 50)
        assert seq.tolist() == want and list(map(tuple, rules.tolist())) == made
        assert (repair.expand(seq, rules, 50) == ids).all()


def test_grammar_rounds_look_at_changed_places_only(monkeypatch):
    looked, repeated = [], repair._repeated
    monkeypatch.setattr(repair, "_repeated", lambda code, *rest: looked.append(len(code)) or repeated(code, *rest))
    ids = (np.random.default_rng(4).zipf(1.2, 300_000) % 20_000).astype(np.uint32)
    seq, rules = repair.compress(ids, 20_000)
    assert len(looked) > 3 and sum(looked[1:]) < len(ids) // 2
    assert (repair.expand(seq, rules, 20_000) == ids).all()


def test_repeated_passage_becomes_one_symbol():
    passage = np.arange(500, dtype=np.uint32)
    seq, rules = repair.compress(np.tile(passage, 300), 500)
    assert repair.rule_lengths(rules, 500).max() >= 500 and len(seq) < 300


def test_token_files_against_plain_ids(spark, tmp_path):
    """Ids, starts and checksums of whole files, and any run of ids, with null and repeated ids and a long text."""
    texts = ["a b", None, "", "the quick brown fox " * 4_000, "Hello, world! 123", "the quick brown fox"]
    df = spark.createDataFrame([(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(5, "the quick brown fox")], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    files = repair.write_tokens(df, path, TOK)
    got = sorted(((-1 if r["id"] is None else r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in repair.read_documents(files, path).collect()))
    from tokenizers import Tokenizer
    lib, want, start, whole = Tokenizer.from_file(TOK), [], 0, []
    lib.no_truncation()
    lib.no_padding()
    for i, t in [(-1, texts[4]), (0, texts[0]), (1, ""), (2, ""), (3, texts[3]), (5, texts[5]), (5, texts[5])]:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        whole.append(ids)
    assert got == want
    whole, at = np.concatenate(whole), 0
    for r in files.orderBy("part").collect():
        if not r["tokens"]:
            continue
        with pa.OSFile(f"{path}/{r['file']}", "rb") as f:
            reader = repair.TokenReader(f)
            for lo, hi in [(0, r["tokens"]), (1, 2), (r["tokens"] // 3, r["tokens"] // 2 + 1)]:
                hi = min(hi, r["tokens"])
                assert (reader.tokens(lo, hi) == whole[at + lo:at + hi]).all()
        at += r["tokens"]


def test_token_files(spark):
    rows = repair.round_trip(docs(spark, ["a b", None, "c"]), TOK).orderBy("id").collect()
    assert [r["n_tokens"] for r in rows] == [3, 1, 2] and [r["start"] for r in rows] == [0, 3, 4]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, None, "same"), (3, "u", None), (None, "u", "x")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    index = warc.write_archives(pages, path)
    got = {r["id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(index, path).collect()}
    assert got == {1: ("revisit", 2, 4), 2: ("response", None, 4), 3: ("response", None, 0), None: ("response", None, 1)}
    r = index.where("id = 2").first()
    assert warc.read_record(path, *r[1:])[1] == b"same"
    assert struct.pack("<I", warc.SEEKABLE_MAGIC) in open(f"{path}/{r['bundle']}", "rb").read()[-4:]


def test_line_windows(spark):
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, ["a\nb\nc\nd", "x\na\nb\nc\ny", None, "a\nb", "q\nq\nq\nq"])).collect()}
    assert got == {0: "a\nb\nc\nd", 1: "x\ny", 2: None, 3: "a\nb", 4: "q"}


def test_mix_respects_budget_and_redistributes(spark):
    rows = [(i, "a" if i < 90 else "b", 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, s string, n long")
    out = mixing.mix(df, {"s": F.col("s")}, F.col("n"), 0.9, {"s": {"a": 0.2, "b": 0.8}}, epochs=4)
    got = {r["s"]: r["t"] for r in out.groupBy("s").agg(F.sum("tokens").alias("t")).collect()}
    assert got == {"a": 500, "b": 400}  # b is short of 720: four epochs, the rest goes to a
    assert mixing.mix(df.limit(0), {"s": F.col("s")}, F.col("n"), 0.9).count() == 0


def test_licences(spark):
    text = "foo bar " * 50 + licences.TEMPLATES["Apache-2.0"] + " baz" * 40
    got = licences.licence_spans(docs(spark, [text, None, "Released under the MIT License", "plain words only"])).collect()
    assert {(r["id"], r["licence"], r["first_word"]) for r in got} == {(0, "Apache-2.0", 100)}


def test_licences_altered(spark):
    t = licences.TEMPLATES
    gpl2 = "x " * 7 + "\n# ".join(t["GPL-notice"].replace("version 3", "version 2").split("; "))
    cases = [("a b Licensed under the Apache License, Version 2.0 (the thing", "Apache-2.0", 2), ("Licensed under the Apache License, Version 2.0", "Apache-2.0", 0),
             ("all Released under the MIT License, and", "MIT", 1), ("Licensed under CC BY-NC 4.0, not sold", "CC-BY-NC-4.0", 0), (gpl2, "GPL-notice", 7),
             ("q // " + t["MIT-disclaimer"].replace('"', "\u201c").replace("COPYRIGHT", "RIGHT"), "MIT-disclaimer", 2),
             (t["BSD-conditions"].replace("following", "next", 1).replace(",", " ,"), "BSD-conditions", 0)]
    got = licences.licence_spans(docs(spark, [c[0] for c in cases])).collect()
    assert {(r["id"], r["licence"], r["first_word"]) for r in got} == {(i, name, at) for i, (_, name, at) in enumerate(cases)}
    rows = licences.licence_spans(docs(spark, list(t.values()))).select("id", "licence").collect()
    names = list(t)
    found = {(names[r["id"]], r["licence"]) for r in rows}
    assert {(n, n) for n in names} <= found
    # Beside itself a notice only holds shorter templates.
    assert all(len(t[b]) < len(t[a]) for a, b in found if a != b)


def test_quality(spark):
    good = ["the cat sat on the mat and the dog ran to the house again"] * 30
    out = kneser_ney.quality(docs(spark, good + ["ZX## QQ%% !!JJ ##KK &&VV %%XX", "", None]), docs(spark, good).select("doc_id"))
    keep = {r["id"]: r["keep"] for r in out.collect()}
    assert not keep[30] and all(keep[i] for i in keep if i != 30)
    assert kneser_ney.quality(docs(spark, good), docs(spark, []).select("doc_id")).where("not keep").count() == 0


def test_hilbert_exact_on_small_tables(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (150, [0.0] * 8), (200, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hilbert.nearest(df, F.col("id") % 50 == 0, curves=2, dims=4).collect()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50):
        s = n @ n[q]
        s[q] = -2
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.lexsort((np.arange(60), -s))[:5].tolist()


def test_hilbert_recall_among_near_copies(spark):
    rng = np.random.default_rng(4)
    x = 1 + 1e-4 * rng.normal(size=(3000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in hilbert.nearest(df, F.col("id") % 50 == 0, curves=16, dims=8, window=150).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        d = ((n - n[q]) ** 2).sum(axis=1)
        hits += len(got & set(np.argsort(d)[1:6].tolist()))
    assert len(found) == 60 and hits >= 0.9 * 5 * 60


def test_hilbert_window_follows_the_points():
    assert hilbert.window_for(50_000) == 640 and hilbert.window_for(1_500_000) == 9725


def test_hilbert_bytes_sort_as_numbers():
    cells = np.random.default_rng(1).integers(0, 64, (500, 10))
    raw = [x.tobytes() for x in hilbert.hilbert_bytes(cells, 6)]
    assert sorted(range(500), key=lambda i: raw[i]) == np.argsort(hilbert.hilbert_key(cells, 6), kind="stable").tolist()
    assert len(hilbert.hilbert_bytes(cells, 24)[0].tobytes()) == 32


@pytest.mark.parametrize("bits,dims", [(2, 2), (3, 3)])
def test_hilbert_neighbours_touch(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = hilbert.hilbert_key(cells, bits)
    order = cells[np.argsort(key)]
    assert sorted(key) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_prefix_tokens_are_shuffled_once(spark, monkeypatch):
    import contextlib
    import io
    import re
    plans, plain = {}, prefixjoin.stash

    def seen(df, name):
        with contextlib.redirect_stdout(io.StringIO()) as text:
            df.explain()
        plans[name] = text.getvalue()
        return plain(df, name)

    monkeypatch.setattr(prefixjoin, "stash", seen)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join(words), " ".join(words[::-1]), "", None]
    got = {r["id"]: r["component_id"] for r in prefixjoin.near_duplicates(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    # A row for every token of every prefix: once through the network, not once to count and once to join.
    assert len(re.findall(r"Exchange hashpartitioning\(token#\d+L?, \d+\)", plans["lists"])) == 1


def test_batches_are_bounded_by_bytes(spark):
    from pulseframe.session import BATCH_BYTES, BATCH_MB, ship_package

    old = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.set(BATCH_BYTES, str(64 << 20))
        ship_package(spark)
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        made = spark.range(0, 9000, 1, 1).selectExpr("repeat('abcdefgh', 400) AS text").mapInArrow(sizes, "n long").collect()
        assert len(made) > 1 and max(r["n"] for r in made) < 2 * BATCH_MB << 20
        spark.conf.set(BATCH_BYTES, str(1 << 20))  # a lower limit of the session stays
        ship_package(spark)
        assert int(spark.conf.get(BATCH_BYTES).rstrip("b")) == 1 << 20
    finally:
        spark.conf.set(BATCH_BYTES, old)


def test_library_encoder_against_library_on_odd_letters():
    from tokenizers import Tokenizer

    from pulseframe.llm.repair import LibraryEncoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    library, encoder = Tokenizer.from_str(spec), LibraryEncoder(spec)
    # A caron joins j, but not J; a bar joins =; special tokens and their names in capitals.
    signs = ["a", "B", "É", "é", "×", "÷", "ß", "J", "I", "İ", "̌", "́", "̇", "=", "̸", ",", ".", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>",
             " ", "\n", "\x85", "1", "²", "Σ", "ς", "ª", "ŉ", "中", "😀", "Å", "-", "<", "À", "Þ", "\x1c", ""]
    rng = random.Random(11)
    for turn in range(400):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(4)]
        if turn % 3:
            texts = [t.replace("<|endoftext|>", "") for t in texts]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want


def test_many_latin_words_against_library():
    """More unseen words than go to the library in one text, also with letters of two bytes and with digits."""
    from tokenizers import Tokenizer
    with open(TOK, encoding="utf-8") as f:
        spec = f.read()
    rng = random.Random(12)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for letters in ("abcdefgs", "aéßñöıÿłŋz", "ab7é-.") for _ in range(700)]
    rng.shuffle(words)
    texts = [" ".join(words[i:i + 300]) for i in range(0, len(words), 300)]
    library, encoder = Tokenizer.from_str(spec), repair.LibraryEncoder(spec)
    library.no_truncation()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_of_a_latin_word_are_one_piece():
    from pulseframe.llm.pieces import PieceTable

    asked = []
    table = PieceTable(lambda new: [p.encode("utf-32-le") for p in new], lambda piece: False, 100)
    found = table.found
    table.found = lambda names: asked.extend(names) or found(names)
    table.encode(["Élan élan, ÉLAN. Word word; WORD!"])
    assert sorted(asked) == sorted({"élan", "word", ",", ".", ";", "!"})
