"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled into one deterministic automaton over
tokens that accepts the right token sequences and nothing else. It begins as a
single state with a loop for each base symbol. A merge (u, v) then adds a gadget:
u's arcs are turned to a copy of their target that lacks v, and wherever u may
stand uv may stand as well, with an arc to v's target. All arcs of a label have
one target, so there is at most one state more than there are merges.

A state is kept as the labels it lacks. The removal of v at some merge takes
with it the longer labels that later merges begin with v; numbered in post-order
of the trees of left parts, these are one interval. So a state is a sorted list of
disjoint intervals, its row of the table, and a transition is a binary search.

A word is read once from the left. The sequences are closed under prefixes and
each prefix has exactly one, so of the labels that end at a place exactly one has
an arc from the state at its own beginning. The time is linear in the word's
length (labels are short), however long the word is. Decoding walks the arcs and
emits their labels.

Splitting into words (normalisation, pattern, special tokens) follows the
vocabulary file; of the file's parts those are read that READ names, anything else
is an error, and so is a vocabulary without all base symbols or with a merge of
something that no earlier merge has made.

The driver reads the file and broadcasts its compiled table, whose size depends
on the vocabulary alone (7 MB for 50,000 labels). Letters are those of Python's Unicode
tables and the additions listed below, which the library has; text normalised by a
table of another year can differ in marks assigned since.

Cases: a null or empty text, or one of white space, has no tokens; special tokens'
strings inside a text are those tokens, as in the library; repeated rows and null
ids are rows like others; an empty table gives none. Other columns than those in
``keep`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

READ = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel")
#: Stands after a word where labels may only end words; no byte is read as it.
END = "\u0100"
ARCS = 1_000_000
#: Fixed value: the public byte-level pattern, for files that leave it to their reader.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it (a class inside a pattern), whatever a regex library takes \s for.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be seen, else the next free one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in seen else chr(free))
        free += b not in seen
    return out


class Automaton:
    """The automaton of a list of merges.

    vocab: label to id; merges: pairs of labels, in order; suffix: ends the labels
    that end a word (empty: any label may).
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        letters = byte_letters()
        of = {c: i for i, c in enumerate(letters)}
        base = [c + end for end in {"", suffix} for c in letters]
        if missing := [c for c in base if c not in vocab]:
            raise ValueError(f"the vocabulary has no {missing[:3]}")
        self.labels: dict[int, str] = {i: s for s, i in vocab.items()}
        n, made = max(self.labels) + 1, {vocab[c] for c in base}
        rules, rank = [], np.full(n, -1, np.int64)
        below: dict[int, list[int]] = {}
        for k, (left, right) in enumerate(merges):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            if u not in made or v not in made or uv in made:
                raise ValueError(f"merge {k} of {left!r} and {right!r} is out of order or repeats a label")
            made.add(uv)
            rules.append((u, v, uv))
            rank[uv] = k
            below.setdefault(u, []).append(uv)
        self._number(n, [vocab[c] for c in base], below)
        self._compile(n, rules, rank, below)
        cut = len(suffix)
        #: Bytes (as characters), and whether a word has to end there.
        self.keys = {t: "".join(chr(of[c]) for c in (s[:-cut] if cut and s.endswith(suffix) else s)) + (END if cut and s.endswith(suffix) else "") for t, s in self.labels.items() if t in made and t not in self.dead}
        self.ends = bool(suffix)

    def _number(self, n: int, roots: list[int], below: dict[int, list[int]]) -> None:
        """Post-order numbers of the labels in the forest of left parts, children by age; and the first number of each tree."""
        self.number, self.begin = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        at, todo = 0, [(r, False) for r in reversed(roots)]
        while todo:
            t, done = todo.pop()
            if done:
                self.number[t], at = at, at + 1
                continue
            self.begin[t] = at
            todo.append((t, True))
            todo += [(c, False) for c in reversed(below.get(t, ()))]

    def _compile(self, n: int, rules: list[tuple[int, int, int]], rank: np.ndarray, below: dict[int, list[int]]) -> None:
        target, uses = [0] * n, {0: n}
        lacks: list[tuple[array, array] | None] = [(array("i"), array("i"))]
        number, begin, self.dead = self.number.tolist(), self.begin.tolist(), set()
        for k, (u, v, uv) in enumerate(rules):
            q = target[u]
            low, high = lacks[q]
            i = bisect_right(low, number[v])
            if u in self.dead or v in self.dead or (i and number[v] <= high[i - 1]):
                self.dead.add(uv)  # v never follows u: this merge never happens
                continue
            younger = [c for c in below.get(v, ()) if rank[c] >= k]  # uv itself among them if u = v
            low, high = low[:], high[:]
            low.insert(i, begin[younger[0]] if younger else number[v])
            high.insert(i, number[v])
            uses[target[uv]] -= 1
            target[uv] = target[v]  # for u = v the state before the copy: a third u may follow the pair
            uses[target[uv]] += 1
            lacks.append((low, high))
            uses[q] -= 1
            target[u] = len(lacks) - 1
            uses[target[u]] = 1
            if not uses[q] and q:
                lacks[q] = None
        states = sorted({0, *target})
        at = {s: i for i, s in enumerate(states)}
        self.n_states = len(lacks)
        self.target = array("i", [at[s] for s in target])
        self.low, self.high, self.row = array("i"), array("i"), array("i", [0])
        for s in states:
            self.low.extend(lacks[s][0])
            self.high.extend(lacks[s][1])
            self.row.append(len(self.low))

    def follows(self, state: int, label: int) -> bool:
        """Whether the state has an arc with that label."""
        x = self.number[label]
        i = bisect_right(self.low, x, self.row[state], self.row[state + 1]) - 1
        return i < self.row[state] or x > self.high[i]

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Reads words; made in each task's Python. Keeps the ARCS transitions met last as they are looked up again and again."""

    def __init__(self, a: Automaton):
        self.a, self.arcs = a, {}
        self.found = ahocorasick.Automaton()
        number = a.number.tolist()
        for t, key in a.keys.items():
            self.found.add_word(key, (t, len(key), number[t]))
        self.found.make_automaton()

    def word(self, raw: bytes) -> list[int]:
        """The labels of a word of at least one byte."""
        a, arcs = self.a, self.arcs
        n = len(raw) + a.ends
        state, last, back = [0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        for end, (t, size, x) in self.found.iter(raw.decode("latin-1") + (END if a.ends else "")):
            end += 1
            if last[end] < 0:  # else the only one is found
                begin = end - size
                key = state[begin] << 32 | x
                to = arcs.get(key)
                if to is None:
                    if len(arcs) >= ARCS:
                        arcs.clear()
                    to = arcs[key] = a.target[t] if a.follows(key >> 32, t) else -1
                if to >= 0:
                    last[end], back[end], state[end] = t, begin, to
        out = []
        while n > 0:
            out.append(last[n])
            n = back[n]
        return out[::-1]


class Tokenizer:
    """A vocabulary file, compiled: how texts fall into words, and the automaton of the words."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or spec["post_processor"]:
            raise ValueError("only plain merges are read")
        self.steps = []
        for x in self._parts(spec["normalizer"], "normalizers"):
            self.steps.append((x["type"], x.get("pattern", {}).get("Regex"), x.get("content")))
        self.pattern, self.prefix = None, False
        for x in self._parts(spec["pre_tokenizer"], "pretokenizers"):
            if x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"]:
                self.pattern = x["pattern"]["Regex"]
            elif x["type"] == "ByteLevel":
                self.prefix = x["add_prefix_space"]
                self.pattern = BYTE_LEVEL if x["use_regex"] else self.pattern
            else:
                raise ValueError(f"cannot split by {x}")
        if self.pattern is None:
            raise ValueError("the file has no pattern of words")
        if spec["decoder"] and spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("cannot decode that way")
        self.bytes_back = bool(spec["decoder"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("only plain special tokens are read")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton({s: i for s, i in model["vocab"].items() if s not in self.special}, merges, model.get("end_of_word_suffix") or "")

    @staticmethod
    def _parts(x: dict | None, inner: str) -> list[dict]:
        parts = [] if x is None else x[inner] if x["type"] == "Sequence" else [x]
        for p in parts:
            if p["type"] not in READ:
                raise ValueError(f"{p['type']} is not read")
        return parts

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))


#: Letters and numbers of Unicode 16, which the library knows and Python's tables do not.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Capitals younger than Python's tables, which the library lowers.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7DC: 0x019B} | {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Fixed value: between these two the library does not compose.
APART = re.compile("(?<=\U00011935)(?=\U00011930)")
CAPITALS = re.compile(f"[{''.join(map(chr, NEW_LOWER))}]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def western(text: str) -> bool:
    """Whether all is Latin-1, quickly."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@cache
def of_kind(kind: str, top: int) -> str:
    """The code points below top whose category begins with ``kind``, as the inside of a class."""
    out, last = [], -2
    new = {c for a, b in {"L": NEW_LETTERS, "N": NEW_NUMBERS}.get(kind, ()) for c in range(a, b + 1)}
    for c in range(top):
        if c in new or unicodedata.category(chr(c)).startswith(kind):
            if c != last + 1:
                out.append([c, c])
            out[-1][1] = last = c
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def classes(pattern: str, top: int = 0x110000) -> str:
    r"""The pattern for Python's own library: \s and \S as Unicode's White_Space,
    \p{..} as ranges up to ``top``, in and out of classes."""
    inside = False

    def put(m: re.Match) -> str:
        nonlocal inside
        if m[1] in ("[", "]"):
            inside = m[1] == "["
            return m[1]
        if m[1] == r"\S":
            return m[1] if inside else f"[^{SPACE}]"
        own = SPACE if m[1] == r"\s" else of_kind(m[2], top) if m[2] else None
        return m[1] if own is None else own if inside else f"[{own}]"

    return re.sub(r"(\\p\{(\w+)\}|\\.|\[|\])", put, pattern)


class Known(dict):
    """Words and their ids, packed; forgets all beyond ``room`` words."""

    def __init__(self, reader: Reader, room: int):
        super().__init__()
        self.word, self.room = reader.word, room

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.room:
            self.clear()
        ids = self.word(word.encode())
        self[word] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class Encoder:
    """Encodes texts; remembers the labels of at most room words."""

    def __init__(self, t: Tokenizer, room: int = 400_000):
        self.t, self.labels = t, Known(t.automaton.reader(), room).__getitem__
        self.low, self.all = (re.compile(classes(t.pattern, top)).findall for top in (0x10000, 0x110000))  # the first is quicker
        self.steps = [(kind, self._replaced(p, content) if p else None) for kind, p, content in t.steps]
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(t.special, key=len, reverse=True)))})") if t.special else None

    @staticmethod
    def _replaced(pattern: str, content: str):
        if (pattern, content) == (r"\s+", " "):  # leaves alone what is a single blank already
            return partial(re.compile(f"[{SPACE.replace(' ', '')}][{SPACE}]*| [{SPACE}]+").sub, " ")
        return partial(re.compile(classes(pattern)).sub, content.replace("\\", r"\\"))

    def normal(self, text: str) -> str:
        old = western(text)
        for kind, replaced in self.steps:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text) if old or not APART.search(text) else "".join(unicodedata.normalize("NFC", x) for x in APART.split(text))
            elif kind == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
                text = text if old or not CAPITALS.search(text) else text.translate(NEW_LOWER)
            else:
                text = replaced(text)
        return text

    def words(self, text: str) -> list[str]:
        return self.low(text) if western(text) or not ASTRAL.search(text) else self.all(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        out, special = [], self.t.special
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in special:
                out.append(special[piece].to_bytes(4, "little"))
            elif piece:
                piece = self.normal(piece)
                if self.t.prefix and not piece.startswith(" "):
                    piece = " " + piece
                out += map(self.labels, self.words(piece))
        return b"".join(out)


class Decoder:
    """Texts of packed ids: the arcs' labels, joined as the file says."""

    def __init__(self, t: Tokenizer):
        self.t = t
        self.names = t.automaton.labels | {i: s for s, i in t.special.items()}
        if t.bytes_back:
            of = {c: i for i, c in enumerate(byte_letters())}
            self.raw = {i: bytes(of[c] for c in s) for i, s in t.automaton.labels.items()} | {i: s.encode() for s, i in t.special.items()}

    def decode(self, ids: bytes | None) -> str:
        tokens = np.frombuffer(ids or b"", "<u4").tolist()
        if self.t.bytes_back:
            return b"".join([self.raw[i] for i in tokens]).decode("utf-8", "replace")
        return " ".join([self.names[i] for i in tokens])


def _mapped(df: DataFrame, name: str, keep: tuple[str, ...], schema: str, make) -> DataFrame:
    rows = df.select(*keep, F.col(name).alias(f"__{name}"))
    new = T._parse_datatype_string(schema).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            if b.num_rows:
                made = f(b.column(b.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, *[x.name for x in new]])

    return rows.mapInArrow(run, T.StructType([*df.select(*keep).schema.fields, *new]))


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, ids (packed, little-endian, 32 bits wide) and n_tokens of each row."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        one = Encoder(shared.value).encode

        def f(texts: pa.Array) -> list[pa.Array]:
            ids = [one(t.as_py()) for t in texts]
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

        return f

    return _mapped(df, text, keep, "ids binary, n_tokens long", make)


def decode(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and decoded, the text of each row's packed ids (null: empty)."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def make():
        one = Decoder(shared.value).decode
        return lambda packed: [pa.array([one(x.as_py()) for x in packed], pa.string())]

    return _mapped(df, ids, keep, "decoded string", make)


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the packed ids and of the decoded text, by word_bpe_49k.json or the vocabulary at ``path``."""
    import public_tokenizers

    tokenizer = Tokenizer.load(path or public_tokenizers.path("word_bpe_49k.json"))
    encoded = encode(table(spark, sf_dir, "documents"), tokenizer)
    kept = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(kept, tokenizer, keep=("doc_id", "n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
