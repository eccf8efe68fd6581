"""Token files compressed by Re-Pair grammars.

Documents are encoded with the tokenizers library, an end id is appended to
each, and the ids are written in ascending document order: one file for each
range of ids, made of blocks of at most ``BLOCK_TOKENS`` ids. Each block has a
grammar of its own: frequent adjacent id pairs are replaced by nonterminals,
again and again; rules, their expansion lengths and the document lengths are
stored with it. All pairs of a round that occur often enough are replaced at
once (the more frequent one where two overlap), and rounds go on until no pair does.
Any run of ids is decoded from the symbols that cover it, found by the
cumulated expansion lengths.

File: blocks, then a footer (JSON, Zstandard) with each block's place, first
token and counts, the document ids and their lengths, then the footer's size
and the magic number. Numbers are little-endian; symbols and rules take 16
bits where vocabulary and rules allow it, else 32.

Defined cases: null text counts as empty (its ids are the end id alone); rows
without id come first; rows with equal id follow in text order; empty tables
give no files.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.bpe import END, PATTERN, batches_of, byte_letters
from pulseframe.llm.pieces import PieceTable
from pulseframe.llm.tables import fresh_path, partitions, running_offsets, stash, text_or_empty
from pulseframe.llm.warc import filesystem
from pulseframe.session import ship_package

BLOCK_TOKENS = 1 << 20
LEAST_COUNT = 12       # occurrences that make a pair worth a rule
SLOT_BITS = 20
PIECES_KEPT = 400_000
WORDS_AT_ONCE = 200    # in one text for the library: longer ones leave the processor's cache
LATIN_END = "\u0250"   # letters below it are the same in every Unicode version
MAGIC = 0x52455031


# -- grammar -----------------------------------------------------------------

def compress(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule k (a pair of symbols) is symbol vocabulary + k.

    Rounds go on until no pair occurs ``LEAST_COUNT`` times without overlap. A
    round replaces every pair that does, frequent ones first where two overlap.
    A rare pair never becomes frequent, so a round looks only at places beside
    a new symbol and at those of frequent pairs that the round before left."""
    seq, rules = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)]
    size, live = vocabulary, np.arange(max(len(seq) - 1, 0))
    while len(seq) >= 2 * LEAST_COUNT:
        code = seq[live].astype(np.uint64) * np.uint64(size) + seq[live + 1]
        pairs, at, number, count = _repeated(code, live)
        if not len(pairs):
            break
        open_ = np.zeros(len(seq) + 1, bool)
        open_[at] = True
        # Places that were left out inside a run of one symbol.
        run = at[(pairs // np.uint64(size) == pairs % np.uint64(size))[number]]
        run = run[run + 2 < len(seq)]
        open_[run[seq[run + 2] == seq[run]] + 1] = True
        at, number = _apart(at, number, count, len(seq))
        # What is left of a pair after its rivals took their places may be too
        # rare; the most frequent pair keeps all of its places.
        chosen = np.bincount(number, minlength=len(pairs)) >= LEAST_COUNT
        held = chosen[number]
        at, number = at[held], number[held]
        rank = np.cumsum(chosen) - 1
        seq[at] = (size + rank[number]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, open_ = seq[keep], open_[:-1][keep]
        new = at - np.arange(len(at))
        open_[new] = True
        open_[np.maximum(new - 1, 0)] = True
        live = np.flatnonzero(open_[:-1])
        made = pairs[chosen]
        rules.append(np.stack([made // np.uint64(size), made % np.uint64(size)], 1).astype(np.uint32))
        size += len(made)
    return seq, np.concatenate(rules)


def _repeated(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs ``code`` at ascending places that occur ``LEAST_COUNT`` times
    without overlap, those places, the pair at each place, and the pairs' counts."""
    if len(code) > 1 << 16:
        # Counts by hashed slot leave few pairs to tell apart: a pair's slot counts it at least.
        slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
        i = np.flatnonzero((np.bincount(slot, minlength=1 << SLOT_BITS) >= LEAST_COUNT)[slot])
        code, place = code[i], place[i]
    # Inside a run of one pair every other place counts.
    same = np.flatnonzero((code[1:] == code[:-1]) & (place[1:] == place[:-1] + 1)) + 1
    if len(same):
        order = np.arange(len(same))
        first = np.maximum.accumulate(np.where(np.diff(same, prepend=-1) != 1, order, 0))
        other = same[(order - first) % 2 == 0]
        code, place = np.delete(code, other), np.delete(place, other)
    coded = pa.array(code).dictionary_encode()
    pairs, number = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    count = np.bincount(number, minlength=len(pairs))
    often = np.flatnonzero(count >= LEAST_COUNT)
    often = often[np.argsort(pairs[often])]
    rank = np.full(len(pairs), -1, np.int32)
    rank[often] = np.arange(len(often))
    number = rank[number]
    held = number >= 0
    return pairs[often], place[held], number[held], count[often]


def _apart(at: np.ndarray, number: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that don't overlap: of overlapping pairs the more frequent one
    stays (ties: the smaller pair). Places between two that go are tried again."""
    place = np.empty(len(count), np.int32)
    place[np.lexsort((np.arange(len(count)), -count))] = np.arange(len(count), 0, -1)
    weight = np.zeros(n + 2, np.int32)  # of the place before
    stays = np.zeros(len(at), bool)
    i, p, mine = np.arange(len(at)), at + 1, place[number]
    weight[p] = mine
    while len(i):
        # Equal neighbours don't occur: runs of one pair were thinned before.
        wins = (mine > weight[p - 1]) & (mine > weight[p + 1])
        stays[i[wins]] = True
        won = p[wins]
        weight[won - 1] = weight[won + 1] = weight[won] = 0
        left = weight[p] > 0
        i, p, mine = i[left], p[left], mine[left]
    return at[stays], number[stays]


def rule_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Expansion length of every rule; a rule uses earlier rules only."""
    n = np.ones(len(rules), np.int64)
    level = levels(rules, vocabulary)
    for k in range(1, int(level.max(initial=0)) + 1):
        i = np.flatnonzero(level == k)
        n[i] = sum(np.where(rules[i, s] >= vocabulary, n[np.maximum(rules[i, s].astype(np.int64) - vocabulary, 0)], 1) for s in (0, 1))
    return n


def levels(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Height of every rule above the ids (1: a pair of ids)."""
    out = np.ones(len(rules), np.int64)
    while True:
        under = [np.where(rules[:, s] >= vocabulary, out[np.maximum(rules[:, s].astype(np.int64) - vocabulary, 0)], 0) for s in (0, 1)]
        new = 1 + np.maximum(*under) if len(rules) else out
        if (new == out).all():
            return out
        out = new


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (``size`` of them), for one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of symbols: each rule is expanded once, lowest level first, and
    the symbols are copied from there."""
    if not len(rules):
        return seq.astype(np.uint32)
    size = np.concatenate([np.ones(vocabulary, np.int64), rule_lengths(rules, vocabulary)])
    start = np.cumsum(size) - size
    flat = np.arange(int(size.sum()), dtype=np.uint32)  # of the ids: themselves
    level = levels(rules, vocabulary)
    for k in range(1, int(level.max()) + 1):
        i = np.flatnonzero(level == k)
        parts = rules[i].ravel()
        flat[_runs(start[vocabulary + i], size[vocabulary + i])] = flat[_runs(start[parts], size[parts])]
    return flat[_runs(start[seq], size[seq])]


# -- files -------------------------------------------------------------------

class TokenWriter:
    """Blocks to an open stream, then the footer."""

    def __init__(self, out, vocabulary: int):
        self.out, self.vocabulary = out, vocabulary
        self.held, self.size, self.at, self.tokens = [], 0, 0, 0
        self.blocks, self.ids, self.lens = [], [], []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc, ids: np.ndarray) -> None:
        self.ids.append(doc)
        self.lens.append(len(ids))
        for i in range(0, len(ids), BLOCK_TOKENS):
            part = ids[i:i + BLOCK_TOKENS]
            if self.size + len(part) > BLOCK_TOKENS:
                self.flush()
            self.held.append(part)
            self.size += len(part)

    def flush(self) -> None:
        if not self.size:
            return
        seq, rules = compress(np.concatenate(self.held), self.vocabulary)
        kind = "<u2" if self.vocabulary + len(rules) <= 1 << 16 else "<u4"
        parts = [rules.astype(kind).tobytes(), rule_lengths(rules, self.vocabulary).astype("<u4").tobytes(), self.zstd.compress(seq.astype(kind).tobytes())]
        for p in parts:
            self.out.write(p)
        self.blocks.append({"at": self.at, "bytes": [len(p) for p in parts], "kind": kind, "rules": len(rules),
                            "symbols": len(seq), "token": self.tokens, "tokens": self.size})
        self.at += sum(map(len, parts))
        self.tokens += self.size
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        foot = {"vocabulary": self.vocabulary, "blocks": self.blocks, "ids": self.ids, "lens": self.lens}
        data = self.zstd.compress(json.dumps(foot).encode())
        self.out.write(data + struct.pack("<II", len(data), MAGIC))


class TokenReader:
    """Decodes documents or any run of tokens of an open file."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        f.seek(size - 8)
        n, magic = struct.unpack("<II", f.read(8))
        if magic != MAGIC:
            raise ValueError("not a token file")
        f.seek(size - 8 - n)
        foot = json.loads(zstandard.ZstdDecompressor().decompress(f.read(n)))
        self.vocabulary, self.blocks, self.ids = foot["vocabulary"], foot["blocks"], foot["ids"]
        self.starts = np.concatenate([[0], np.cumsum(foot["lens"])]).astype(np.int64)

    def grammar(self, k: int):
        """(symbols, rules, expansion length of every rule) of a block."""
        b = self.blocks[k]
        self.f.seek(b["at"])
        rules, lens, seq = (self.f.read(n) for n in b["bytes"])
        rules = np.frombuffer(rules, b["kind"]).reshape(-1, 2).astype(np.uint32)
        seq = zstandard.ZstdDecompressor().decompress(seq, max_output_size=b["symbols"] * int(b["kind"][2]))
        return np.frombuffer(seq, b["kind"]), rules, np.frombuffer(lens, "<u4")

    def block(self, k: int) -> np.ndarray:
        seq, rules, _ = self.grammar(k)
        return expand(seq, rules, self.vocabulary)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids [start, stop) of the file, from the covering symbols only."""
        out = [np.zeros(0, np.uint32)]
        for k, b in enumerate(self.blocks):
            lo, hi = max(start - b["token"], 0), min(stop - b["token"], b["tokens"])
            if lo < hi:
                seq, rules, lens = self.grammar(k)
                size = np.concatenate([np.ones(self.vocabulary, np.int64), lens])[seq]
                ends = np.cumsum(size)
                i, j = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
                skip = lo - (ends[i] - size[i])
                out.append(expand(seq[i:j], rules, self.vocabulary)[skip:skip + hi - lo])
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self):
        """(position, ids) of every document, block by block."""
        rest, i = np.zeros(0, np.uint32), 0
        for k in range(len(self.blocks)):
            rest = np.concatenate([rest, self.block(k)])
            used = 0
            while i < len(self.ids) and used + (n := int(self.starts[i + 1] - self.starts[i])) <= len(rest):
                yield i, rest[used:used + n]
                used, i = used + n, i + 1
            rest = rest[used:]


# -- Spark -------------------------------------------------------------------

def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write below ``path``; returns one row per file (part, file,
    documents, tokens, bytes)."""
    ship_package(df.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    n = max(1, partitions(df.sparkSession))

    def write(batches):
        import os
        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = library_encoder(spec.value)
        task = TaskContext.get()
        fs, root = filesystem(path)
        name = f"tokens-{task.partitionId():06d}.rep"
        draft = f"{root}/.{name}-{task.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        out, end = fs.open_output_stream(draft), np.array([end_id], "<u4")
        writer = TokenWriter(out, max(encoder.size, end_id + 1))
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for s in batches_of(texts):
                for doc, data in zip(ids[s], encoder.encode(texts[s])):
                    writer.add(doc, np.concatenate([np.frombuffer(data, "<u4"), end]))
        writer.close()
        size = out.tell()
        out.close()
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "documents": pa.array([len(writer.ids)], pa.int64()),
                                          "tokens": pa.array([writer.tokens], pa.int64()), "bytes": pa.array([size], pa.int64())})

    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    dealt = docs.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    return stash(dealt.mapInArrow(write, "part int, file string, documents long, tokens long, bytes long"), "token-files")


class LibraryEncoder:
    """The tokenizers library behind a bounded table of white-space separated
    pieces: its pattern never crosses white space, so a text's ids are those
    of its pieces."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = PieceTable(self.learn, self.has_special, PIECES_KEPT)
        self.words = regex.compile(PATTERN)
        # For lower-case Latin words, which need neither normalizer nor pattern, in byte letters.
        self.plain = Tokenizer.from_str(spec)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = np.array([ord(c) for c in byte_letters()], "<u4")
        self.letters[ord(" ")] = ord(" ")  # between words
        self.ends = np.zeros(self.size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(END)

    def has_special(self, piece: str) -> bool:
        return any(s in piece for s in self.special)

    def alone(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> list[bytes]:
        """Encode unseen pieces, many in one text: every word of a piece ends
        with a word-end token, so the ids are cut by the pieces' word counts."""
        out, words, at, rest = [b""] * len(new), [], [], []
        for i, p in enumerate(new):
            q = (p if p.isascii() else unicodedata.normalize("NFC", p)).lower()
            if q.isalpha() and (q.isascii() or max(q) < LATIN_END):
                words.append(q)
                at.append(i)
            else:
                rest.append((i, p, 1 if q.isalpha() else len(self.words.findall(q))))
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i:i + WORDS_AT_ONCE]
            text = " ".join(part)
            if not text.isascii():  # ASCII letters stand for themselves
                text = self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            for k, data in zip(at[i:i + WORDS_AT_ONCE], self.cut(self.plain, text, part, [1] * len(part))):
                out[k] = data
        for i in range(0, len(rest), WORDS_AT_ONCE):
            part = [p for _, p, _ in rest[i:i + WORDS_AT_ONCE]]
            size = [n for _, _, n in rest[i:i + WORDS_AT_ONCE]]
            for (k, _, _), data in zip(rest[i:i + WORDS_AT_ONCE], self.cut(self.library, " ".join(part), part, size)):
                out[k] = data
        return out

    def cut(self, tokenizer, text: str, part: list[str], size: list[int]) -> list[bytes]:
        """The ids of ``text``, cut into those of its pieces ``part``."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        last, ends = np.cumsum(size), np.flatnonzero(self.ends[ids])
        if len(ends) != last[-1] or min(size) == 0:  # special tokens inside, or an odd fold
            return [self.alone(p) for p in part]
        at = [0] + (4 * (ends[last - 1] + 1)).tolist()
        data = ids.tobytes()
        return [data[x:y] for x, y in zip(at, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.table.encode(texts)


_ENCODERS: dict[int, LibraryEncoder] = {}


def library_encoder(spec: str) -> LibraryEncoder:
    """One encoder for a worker, so that later tasks find it warm."""
    if hash(spec) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[hash(spec)] = LibraryEncoder(spec)
    return _ENCODERS[hash(spec)]


def read_documents(files: DataFrame, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the files."""
    offsets = running_offsets(files.select("part", "file", "tokens"), "tokens")

    def read(batches):
        fs, root = filesystem(path)
        for b in batches:
            for name, offset in zip(b.column("file").to_pylist(), b.column("offset").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    reader, rows = TokenReader(f), []
                    for i, ids in reader.documents():
                        rows.append((reader.ids[i], offset + int(reader.starts[i]), len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "n_tokens", "ids_crc32"])

    n = max(1, partitions(files.sparkSession))
    return offsets.select("file", "offset").repartition(n, "file").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    path = fresh_path(df.sparkSession, "tokens")
    return read_documents(write_tokens(df, path, tokenizer, **options), path)
