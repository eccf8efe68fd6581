"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of the corpus (counted over all of it) are compiled, with
the token ids that the merge rules give them, into a minimal acyclic automaton:
words share prefixes and suffixes, and the outputs summed along a word's path
are its number, which points to its ids. The automaton is a few flat arrays in
one file that each task maps into memory. Words outside the lexicon are merged
exactly by the ranked merge rules. The result equals the tokenizers library's
for vocabularies of the word-end kind (NFC, white space folded, lower case,
pattern split, byte symbols, ``</w>`` on a word's last symbol); its path is a
parameter.

A text is cut at white space; ids of recent pieces are kept in a table of
bounded size. Defined cases: null text counts as empty (no ids); special
tokens inside a text are kept as single ids, as the library does; rows are
encoded one by one, repeated ones too.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.pieces import PieceTable
from pulseframe.llm.tables import discard, stash, text_or_empty

LEXICON_WORDS = 50_000   # words compiled into the automaton at most
PIECES_KEPT = 300_000    # white-space separated pieces remembered by a worker at most
# Fixed value: the pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"

NO_RANK = np.iinfo(np.int32).max
GOLDEN = 0x9E3779B97F4A7C15
LONG_WORD = 48  # bytes; longer words are merged one by one


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible
    Latin-1 letters stand for themselves, the other bytes follow from U+0100."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Rules:
    """Vocabulary and merge rules of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {**vocab, **self.special}
        self.tokens = [""] * (max(names.values()) + 1)
        for t, i in names.items():
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + END] for c in letters]
        self.merge = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # Open-addressed table of the rules: pair code -> rank, new id.
        self.base = np.int64(len(self.tokens))
        self.shift = np.uint64(64 - max(4, (4 * len(self.merge)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, NO_RANK, np.int32)
        self.slot_new = np.zeros(size, np.int32)
        self.probes = 1
        for (x, y), (rank, new) in self.merge.items():
            code = x * int(self.base) + y
            slot, n = ((code * GOLDEN) & (1 << 64) - 1) >> int(self.shift), 1
            while self.slot_key[slot] >= 0:
                slot, n = (slot + 1) % size, n + 1
            self.slot_key[slot], self.slot_rank[slot], self.slot_new[slot] = code, rank, new
            self.probes = max(self.probes, n)

    def ranks(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NO_RANK: no rule) and slot of pair codes."""
        slot = ((code.astype(np.uint64) * np.uint64(GOLDEN)) >> self.shift).astype(np.int64)
        for _ in range(self.probes - 1):
            miss = (self.slot_key[slot] != code) & (self.slot_key[slot] >= 0)
            if not miss.any():
                break
            slot = np.where(miss, (slot + 1) % len(self.slot_key), slot)
        return np.where(self.slot_key[slot] == code, self.slot_rank[slot], NO_RANK), slot

    def words(self, data: list[bytes]) -> list[list[int]]:
        """Merge many words, all in step: in each round every word merges its
        pair of lowest rank, leftmost first."""
        out: list = [None] * len(data)
        lens = np.array([len(w) for w in data], np.int64)
        for i in np.flatnonzero(lens > LONG_WORD):
            out[i] = self.word(data[i])
        order = np.argsort(lens, kind="stable")
        order = order[(lens[order] > 0) & (lens[order] <= LONG_WORD)]
        inner, final = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        for part in np.array_split(order, max(1, len(order) // 20_000)):
            if not len(part):
                continue
            width = int(lens[part].max())
            raw = np.frombuffer(b"".join(data[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            size = lens[part].copy()
            ids = inner[raw]
            ids[np.arange(len(part)), size - 1] = final[raw[np.arange(len(part)), size - 1]]
            rows = part
            while len(rows):
                code = ids[:, :-1] * self.base + ids[:, 1:]
                rank, slot = self.ranks(code)
                rank = np.where(np.arange(1, ids.shape[1]) < size[:, None], rank, NO_RANK)
                at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                go = rank[np.arange(len(rows)), at] < NO_RANK if rank.shape[1] else np.zeros(len(rows), bool)
                for i, x, n in zip(rows[~go].tolist(), ids[~go].tolist(), size[~go].tolist()):
                    out[i] = x[:n]
                rows, ids, at, slot, size = rows[go], ids[go], at[go], slot[go], size[go] - 1
                if not len(rows):
                    break
                new = self.slot_new[slot[np.arange(len(rows)), at]]
                take = np.arange(ids.shape[1] - 1)
                ids[np.arange(len(rows)), at] = new
                ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)[:, :max(1, int(size.max()))]
        return out

    def word(self, data: bytes) -> list[int]:
        """Merge one long word by a heap of its pairs (rank, place)."""
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        left, right = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        get, end = self.merge.get, len(ids)
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(end - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= end or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], right[i] = get((a, b))[1], -1, right[j]
            if right[j] < end:
                left[right[j]] = i
                if m := get((ids[i], ids[right[j]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[right[j]]))
            if left[i] >= 0 and (m := get((ids[left[i]], ids[i]))):
                heapq.heappush(heap, (m[0], left[i], ids[left[i]], ids[i]))
        return [x for x in ids if x >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of ``words`` as one file: sorted
    transition keys (state * 256 + byte), targets, outputs, final marks, and
    the ids by word number. States are merged with equal finished ones while
    the sorted words are added, so common suffixes are stored once."""
    order = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # finished: final, arcs
    path: list[list] = [[False, []]]                       # open: final, arcs

    def finish(state) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(states)
            states.append((state[0], list(state[1])))
        return register[key]

    last = b""
    for w in order + [None]:
        keep = 0
        if w is not None:
            while keep < min(len(w), len(last)) and w[keep] == last[keep]:
                keep += 1
        for k in range(len(last), keep, -1):
            path[k - 1][1].append((last[k - 1], finish(path.pop())))
        if w is None:
            break
        path += [[False, []] for _ in w[keep:]]
        path[-1][0] = True
        last = w
    root = finish(path[0])
    below = [0] * len(states)  # words below each state; targets are finished before their sources
    arcs = []
    for i, (final, out) in enumerate(states):
        n = int(final)
        for b, t in out:
            arcs.append((i * 256 + b, t, n))
            n += below[t]
        below[i] = n
    arcs.sort()
    ids = [words[w] for w in order]
    parts = {"root": np.array([root], np.int64), "key": np.array([a[0] for a in arcs], np.int64),
             "to": np.array([a[1] for a in arcs], np.int32), "out": np.array([a[2] for a in arcs], np.int32),
             "final": np.array([s[0] for s in states], np.uint8),
             "at": np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64),
             "ids": np.array([i for x in ids for i in x], np.uint32)}
    head, blobs, pos = [], [], 0
    for name, a in parts.items():
        head.append([name, a.dtype.str, pos, len(a)])
        blobs.append(a.tobytes() + b"\0" * (-a.nbytes % 8))
        pos += len(blobs[-1])
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(blobs)


class Lexicon:
    """A compiled automaton mapped into memory."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:  # a nameless file of this worker, mapped read-only
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        for name, kind, pos, count in json.loads(self.map[8:8 + n]):
            setattr(self, name, np.frombuffer(self.map, dtype=kind, count=count, offset=8 + n + pos))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Word numbers (-1: not in the lexicon), all words in step."""
        lens = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(lens)])[:-1]
        state = np.full(len(words), self.root[0], np.int64)
        number = np.zeros(len(words), np.int64)
        live = np.flatnonzero(lens > 0) if len(self.key) else np.zeros(0, np.int64)
        state[lens == 0] = -1
        if not len(self.key):
            state[:] = -1
        k = 0
        while len(live):
            key = state[live] * 256 + flat[at[live] + k]
            i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[i] == key
            state[live] = np.where(ok, self.to[i], -1)
            number[live] += np.where(ok, self.out[i], 0)
            k += 1
            live = live[ok & (lens[live] > k)]
        good = state >= 0
        good[good] = self.final[state[good]] != 0
        return np.where(good, number, -1)


def frequent_words(df: DataFrame, text_col: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent lower-case letter words of all texts, at most
    ``limit``. The cut is found on a histogram of counts (exact below 4,096, by
    1/64 octave above); words as frequent as the first that doesn't fit stay
    out, so no more than ``limit`` words reach the driver."""
    words = df.select(F.explode(F.split(F.lower(text_or_empty(text_col)), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    size = F.when(F.col("count") < 4096, F.col("count")).otherwise(F.floor(F.log2("count") * 64) + 4096 - 12 * 64)
    counts = stash(words.groupBy("w").count().where("count > 1").select("w", size.cast("int").alias("size")), "word-counts")
    cut, held = 1 << 30, 0
    for r in counts.groupBy("size").count().orderBy(F.desc("size")).collect():  # 4,096 + 64 rows an octave at most
        if held + r["count"] > limit:
            break
        cut, held = r["size"], held + r["count"]
    top = [r["w"] for r in counts.where(F.col("size") >= cut).collect()]
    discard(counts)
    return sorted(top)


def lexicon_file(rules: Rules, words: list[str]) -> bytes:
    data = list({unicodedata.normalize("NFC", w).encode() for w in words})
    return compile_lexicon(dict(zip(data, rules.words(data))))


class Codec:
    """Encoder and decoder of a worker."""

    def __init__(self, spec: str, lexicon: bytes):
        self.rules, self.lexicon = Rules(spec), Lexicon(lexicon)
        self.pattern = regex.compile(PATTERN + r"|\n")
        self.table = PieceTable(self.learn, self.has_special, PIECES_KEPT)

    def has_special(self, piece: str) -> bool:
        return any(s in piece for s in self.rules.special)

    def learn(self, new: list[str]) -> list[bytes]:
        """The ids of unseen pieces."""
        plain = [p for p in new if not self.has_special(p)]
        # Lower case is by character: a final sigma isn't special.
        text = unicodedata.normalize("NFC", "\n".join(plain)).replace("Σ", "σ").lower()
        words = self.pattern.findall(text)
        distinct = list(dict.fromkeys(words))
        data = [w.encode() for w in distinct]
        number = self.lexicon.numbers(data)
        at, ids = self.lexicon.at, self.lexicon.ids
        known = {}
        unseen = [i for i, k in enumerate(number.tolist()) if k < 0]
        for i, x in zip(unseen, self.rules.words([data[i] for i in unseen])):
            known[distinct[i]] = array("I", x).tobytes()
        for w, k in zip(distinct, number.tolist()):
            if k >= 0:
                known[w] = ids[at[k]:at[k + 1]].tobytes()
        known["\n"] = None
        learned, out = {}, []
        for w in words + ["\n"] if plain else []:
            if (x := known[w]) is None:
                learned[plain[len(learned)]] = b"".join(out)
                out = []
            else:
                out.append(x)
        return [learned[p] if p in learned else self.around_special(p) for p in new]

    def around_special(self, piece: str) -> bytes:
        """The ids of a piece with special tokens inside."""
        parts = [q for q in self.rules.cut.split(piece) if q]
        return b"".join(np.uint32(self.rules.special[q]).tobytes() if q in self.rules.special else self.learn([q])[0] for q in parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.table.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The tokens with blanks between, special ones included."""
        return " ".join(map(self.rules.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def batches_of(texts: list[str], size: int = 4 << 20):
    """Slices of ``texts`` of about ``size`` characters."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


_CODECS: dict = {}


def codec(spec: str, lexicon: bytes) -> Codec:
    """One codec for a worker and lexicon, so that later tasks find it warm."""
    key = (len(spec), hash(lexicon), os.getpid())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec, lexicon)
    return _CODECS[key]
