"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece
model with byte fallback that puts a space before the text; A reads the same
space and text. A token covers bytes: A's entry decoded from its byte letters,
B's piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as that byte.

The cumulative byte ends of either side go to a dictionary end -> index. Ends
that both dictionaries hold, sorted, slice both id lists into groups, the finest
ones that cover the same bytes; each slice is expanded to its links, the pairs of
tokens whose bytes overlap.

Neither tokenizer merges across a single space between two other characters
(A splits its texts there; B's vocabulary, which is searched for it, has no
piece with a space after another character), so a space is a common end and
the words of a text are aligned apart, each distinct one once. Any other white
space beside a space joins its neighbours to one piece.

Counts of linked id pairs cover all texts. Frequent pairs (at most
``SENT_PAIRS``) are sent to the executors, rarer ones meet the texts' pairs in a
shuffled join: no rare pair can be hot.

Defined cases: texts that are null or empty, or whose tokens don't give their
bytes back on either side (a character unknown to B, a U+2581 of the text's own),
have no tokens: zeros and no groups. Rows need no id; repeated rows stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.tables import discard, small, stash, text_or_empty
from pulseframe.session import ship_package

SENT_PAIRS = 1_000_000  # pairs with their counts sent to every executor at most
KNOWN_WORDS = 300_000   # aligned words a worker keeps
CHUNK_BYTES = 4 << 20   # text aligned at a time (a longer text is one chunk)
ID_BITS = 32            # a pair of ids is one long: A's above B's

MARKS = (",", "|", ";", "")  # after an id: within a side, a group, a word

# White space beside a space, and spaces at either end of a text.
_WHITE = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNEVEN = f"{_WHITE} | {_WHITE}|^ | $"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    bytes for themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def align(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Groups of tokens of both sides, from the cumulative ends of their tokens:
    how many of A's and of B's tokens end by each common end (tokens of no bytes
    share the end before them; the last one of an end counts)."""
    ia, ib = (dict(zip(ends, range(1, len(ends) + 1))) for ends in (a_ends, b_ends))
    common = sorted(ia.keys() & ib.keys())
    return tuple(np.fromiter(map(i.__getitem__, common), np.int64, len(common)) for i in (ia, ib))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of the tokens whose bytes overlap: every stretch
    between two neighbouring ends of either side lies in one token of each, and
    never across a slice's end, which is an end of both."""
    cuts = np.union1d(a_ends, b_ends)
    cuts = cuts[cuts > 0]
    return np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts)


def lists_of(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one array and the start of each."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(at[-1])), at


def per_list(values: pa.Array, at: np.ndarray, sep) -> pa.Array:
    """Strings or bytes of each list, joined."""
    kind = pa.large_binary() if isinstance(sep, bytes) else pa.large_string()
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), values.cast(kind)), pa.scalar(sep, kind))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of ``n`` from ``first``, one run after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Known:
    """Aligned words: their places, and by place n_a, n_b, n_groups, n_links,
    groups as text, first link and the links' id pairs."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.sizes, self.first, self.pairs, self.text = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.again = np.zeros(0, bool)  # asked for after the chunk that brought it

    def add(self, words: list[str], sizes: np.ndarray, text: list, pairs: np.ndarray) -> None:
        n = len(self.place)
        self.place.update(zip(words, range(n, n + len(words))))
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(sizes[:, 3]) - sizes[:, 3]])
        self.sizes, self.pairs = np.concatenate([self.sizes, sizes]), np.concatenate([self.pairs, pairs])
        self.text += text
        self.again = np.concatenate([self.again, np.zeros(len(words), bool)])

    def met_again(self) -> "Known":
        """Only the words that a later chunk asked for: most occur once."""
        out, at = Known(), np.flatnonzero(self.again)
        words, text = np.array(list(self.place), object), np.array(self.text, object)
        out.add(words[at].tolist(), self.sizes[at], text[at].tolist(), self.pairs[spread(self.first[at], self.sizes[at, 3])])
        return out


class Aligner:
    """Both tokenizers of a worker and the words it has aligned."""

    def __init__(self, a_spec: str, b_model: bytes, limit: int = KNOWN_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        plain = json.loads(a_spec)["model"]["vocab"]
        a_bytes = [b""] * (max([*plain.values(), *self.a.get_added_tokens_decoder()]) + 1)
        for t, i in plain.items():
            a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i)
                   else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.size = tuple(np.array([len(t) for t in x]) for x in (a_bytes, b_bytes))
        # Every id with each mark that may follow it.
        self.spelled = pa.array([f"{i}{m}" for i in range(max(len(a_bytes), len(b_bytes))) for m in MARKS], pa.large_string())
        # Whether no piece has a space after another character.
        self.cuts = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.limit, self.known = limit, Known()

    def words(self, texts: pa.Array) -> pa.ListArray:
        """The pieces of each text that are aligned apart."""
        lists = pc.split_pattern(texts, " ")
        if self.cuts:
            odd = pc.match_substring_regex(texts, UNEVEN)
            if not pc.any(odd).as_py():
                return lists
            cut = re.compile(r"(?<=\S) (?=\S)").split
        else:
            odd, cut = pa.array([True] * len(texts)), lambda t: [t]
        return pa.array([cut(t.as_py()) if o.as_py() else words.as_py() for t, o, words in zip(texts, odd, lists)], pa.list_(pa.string()))

    def places(self, names: list[str]) -> np.ndarray:
        """Places of words in ``known``, after aligning the new ones."""
        new = [w for w in names if w not in self.known.place]
        if new and len(new) + len(self.known.place) > self.limit:
            self.known = self.known.met_again() if 2 * self.known.again.sum() < self.limit else Known()
            new = [w for w in names if w not in self.known.place]
        else:
            self.known.again[[p for p in map(self.known.place.get, names) if p is not None]] = True
        if new:
            a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in new], add_special_tokens=False)]
            self.known.add(new, *self.aligned(new, a, self.b.encode(new, num_threads=1)))
        return np.fromiter(map(self.known.place.__getitem__, names), np.int64, len(names))

    def aligned(self, words: list[str], a_lists: list[list[int]], b_lists: list[list[int]]) -> tuple:
        """Sizes, groups as text (null for a word whose bytes don't come back)
        and id pairs of words, which are aligned as one run of bytes: their ends
        are ends of both sides."""
        want = pa.array([b" " + w.encode("utf-8") if w else None for w in words], pa.large_binary())
        whole = [pc.equal(per_list(x.take(pa.array(ids)), at, b""), want) for x, (ids, at) in zip(self.bytes, map(lists_of, (a_lists, b_lists)))]
        good = pc.fill_null(pc.and_(*whole), False).to_numpy(zero_copy_only=False)
        (a, a_at), (b, b_at) = (lists_of([x for x, g in zip(lists, good) if g]) for lists in (a_lists, b_lists))
        a_ends, b_ends = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        ga, gb = align(a_ends.tolist(), b_ends.tolist())
        i, j = links_of(a_ends, b_ends)
        sizes = np.zeros((len(words), 4), np.int64)
        ends = a_ends[a_at[1:] - 1]
        sizes[good] = np.stack([np.diff(a_at), np.diff(b_at), np.diff(np.searchsorted(ga, a_at[1:], "right"), prepend=0),
                                np.diff(np.searchsorted(a_ends[i], ends, "right") if len(i) else ends * 0, prepend=0)], axis=1)
        # Text: each group's ids of A, then of B, every id with the mark after it.
        na, nb = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        start = np.cumsum(na + nb) - na - nb
        out = np.empty(len(a) + len(b), np.int64)
        out[spread(start, na)] = a * len(MARKS)
        out[spread(start + na, nb)] = b * len(MARKS)
        mark = np.zeros(len(out), np.int64)
        mark[start + na - 1] = 1
        mark[start + na + nb - 1] = 2
        mark[a_at[1:] + b_at[1:] - 1] = 3
        text = np.full(len(words), None, object)
        text[good] = per_list(self.spelled.take(pa.array(out + mark)), a_at + b_at, "").to_pylist()
        return sizes, text.tolist(), a[i] << ID_BITS | b[j]

    def texts(self, texts: pa.Array):
        """For texts of one chunk: sizes (n_a, n_b, n_groups, n_links), groups
        as text ('' without tokens), the start of each text's pairs, the pairs
        and their times."""
        lists = self.words(texts)
        coded = lists.values.dictionary_encode()
        at = lists.offsets.to_numpy().astype(np.int64)
        codes, place = coded.indices.to_numpy(), self.places(coded.dictionary.to_pylist())
        k = self.known
        spelled, sizes = [k.text[i] for i in place.tolist()], k.sizes[place]
        row = np.repeat(np.arange(len(texts)), np.diff(at))
        bad = np.zeros(len(texts), bool)
        bad[row[np.array([t is None for t in spelled], bool)[codes]]] = True
        groups = pc.if_else(pa.array(bad), "", pc.fill_null(per_list(pa.array(spelled, pa.large_string()).take(pa.array(codes)), at, ";"), ""))
        codes, row = codes[~bad[row]], row[~bad[row]]
        total = np.zeros((len(texts), 4), np.int64)
        for c in range(4):
            total[:, c] = np.bincount(row, weights=sizes[codes, c], minlength=len(texts))
        # Distinct words of each text, then their pairs, then distinct pairs.
        key, times = np.unique(row * max(1, len(place)) + codes, return_counts=True)
        word, row = key % max(1, len(place)), key // max(1, len(place))
        n = sizes[word, 3]
        pair, number = np.unique(k.pairs[spread(k.first[place[word]], n)], return_inverse=True)
        key, back = np.unique(np.repeat(row, n) * max(1, len(pair)) + number, return_inverse=True)
        count = np.bincount(back, weights=np.repeat(times, n), minlength=len(key)).astype(np.int64)
        return total, groups, np.searchsorted(key // max(1, len(pair)), np.arange(len(texts) + 1)), pair[key % max(1, len(pair))], count


_aligners: dict[str, Aligner] = {}


def aligner(a_spec: str, b_model: bytes) -> Aligner:
    """The worker's aligner of two tokenizers."""
    key = hashlib.sha256(a_spec.encode() + b_model).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(a_spec, b_model)
    return _aligners[key]


def chunks(texts: pa.Array):
    """Slices of texts of about CHUNK_BYTES."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, "right")))
        yield slice(i, j)
        i = j


def align_texts(df: DataFrame, a_file: str, b_file: str, text_col: str = "text", keep: list[str] | None = None, spell: bool = True) -> DataFrame:
    """Columns ``keep`` (all, by default, but those named like the new ones),
    n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``, ids in order; with
    ``spell`` false its SHA-256 in hex, without tokens ''), pairs (distinct
    linked id pairs, A's id above B's) and times (links of each)."""
    ship_package(df.sparkSession)
    with open(a_file, encoding="utf-8") as f:
        a_spec = f.read()
    with open(b_file, "rb") as f:
        b_model = f.read()
    files = df.sparkSession.sparkContext.broadcast((a_spec, b_model))  # bounded by the vocabularies
    new = ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    keep = [c for c in df.columns if c not in new] if keep is None else keep

    def run(batches):
        own = aligner(*files.value)
        for b in batches:
            texts = b.column("__text").cast(pa.string())
            for s in chunks(texts):
                sizes, groups, at, *pairs = own.texts(texts.slice(s.start, s.stop - s.start))
                if not spell:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else g for g in groups.to_pylist()]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in pairs]
                kept = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in keep), *(pa.array(x) for x in sizes.T), pa.array(groups, pa.string()), *lists], names=[*keep, *new])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)
    return (df.select(*keep, text_or_empty(text_col).alias("__text"))
            .mapInArrow(run, kinds + "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"))


def _pairs(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(*keep, "p.pairs", "p.times")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair in all texts, and whether no
    other pair of its B id has more."""
    counts = _pairs(rows).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"))
    counts = stash(counts, "pair-counts")
    b = F.col("pair").bitwiseAND((1 << ID_BITS) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row per B id
    return counts.join(small(most, SENT_PAIRS), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach."""
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # 64 rows at most
    cut, held = max(sizes, default=0) + 1, 0
    while cut > 0 and held + sizes.get(cut - 1, 0) <= limit:
        cut -= 1
        held += sizes.get(cut, 0)
    return 1 << cut


def scored(df: DataFrame, a_file: str, b_file: str, keep: list[str], text_col: str = "text", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``keep``, the sizes of ``align_texts``, groups_sha256, ``n_best`` (links
    whose pair is the most frequent one of its B id, ties included) and
    ``count_sum`` (sum of the links' pair counts)."""
    rows = align_texts(df, a_file, b_file, text_col, keep, spell=False)
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = stash(pair_counts(rows), "scored-pairs")
    least = frequent(counts, sent_pairs)
    own = _pairs(rows, "_row").withColumnRenamed("pairs", "pair")
    known = F.broadcast(counts.where(F.col("n") >= least))  # sent_pairs rows at most
    found = own.join(known, "pair", "left")
    if least > 1:
        rest = found.where("n is null").select("_row", "times", "pair").join(counts.where(F.col("n") < least), "pair")
        found = found.where("n is not null").unionByName(rest)
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return (rows.drop("pairs", "times").join(sums, "_row", "left")
            .select(*keep, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("groups").alias("groups_sha256")))
