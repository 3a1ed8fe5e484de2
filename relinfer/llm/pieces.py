"""SentencePiece encoding and decoding (3) as a weighted finite-state transducer.

The transducer is the composition of three: the normaliser (a dummy space in front, spaces
written as U+2581), the pieces (a trie whose final states return to the start and
carry the piece's cost), and byte fallback (a path of byte pieces for every character).
Composed with an input, it is a lattice over the input's positions; the encoding is its
path of least total cost (tropical semiring), by one sweep from left to right. The lattices of
all different words of some texts are swept together, over the trie as arrays.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from relinfer.llm.common import add_columns, byte_groups, chosen_lists

# Place of the piece model unless a caller names another; read on the driver only.
MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
# Bytes of texts whose words are encoded together.
GROUP_BYTES = 1 << 22
# Longer words are swept one by one.
LONG = 64
# Further cost of a byte piece over the dearest piece, as of an unknown character.
BYTE_PENALTY = 10.0

# A word with the spaces in front of it; newlines stand alone. Between words, a sign that texts seldom hold.
PARTS = re.compile("\n| +[^ \n]*|[^ \n]+")
BETWEEN = "\x1f"

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class Trie:
    """The pieces' trie. State 0 is none; `root` has the state of each class of first characters.

    A space has the class of U+2581; that sign itself and characters of no piece have class 0, which leads nowhere.
    """

    classes: np.ndarray
    n_classes: int
    root: np.ndarray
    cost: np.ndarray
    piece: np.ndarray
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, arcs: dict[str, tuple[float, int]]) -> Trie:
        letters = sorted({c for p in arcs for c in p})
        class_of = {c: k for k, c in enumerate(letters, 1)}
        classes = np.zeros(0x110000, np.int32)
        classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        classes[ord(" ")], classes[ord(SPACE)] = class_of.get(SPACE, 0), 0
        n, number = len(letters) + 1, {}
        for p in sorted(arcs, key=len):
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number) + 1)
        cost, piece = np.full(len(number) + 1, np.inf), np.full(len(number) + 1, -1, np.int32)
        for p, (c, i) in arcs.items():
            cost[number[p]], piece[number[p]] = c, i
        root = np.zeros(n, np.int32)
        inner = [(number[p[:-1]] * n + class_of[p[-1]], s) for p, s in number.items() if len(p) > 1]
        for p, s in number.items():
            if len(p) == 1:
                root[class_of[p]] = s
        keys, values = _hash_table(*np.array(inner, np.int64).reshape(-1, 2).T)
        return cls(classes, n, root, cost, piece, keys, values.astype(np.int32))

    def follow(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The states that lead on from `state` with classes `char`; 0 where none does."""
        key = state.astype(np.int64) * self.n_classes + char
        at = _slot(key, len(self.keys))
        held = self.keys[at]
        out = np.where(held == key, self.values[at], 0)
        again = np.flatnonzero((held != key) & (held >= 0))
        while len(again):
            at[again] = (at[again] + 1) & (len(self.keys) - 1)
            held = self.keys[at[again]]
            hit = held == key[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (held >= 0)]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _hash_table(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with a fourth of the places taken at most; free places have the key -1."""
    size = 1 << max(4, (4 * len(key)).bit_length())
    keys, values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    slot, todo = _slot(key, size), np.arange(len(key))
    while len(todo):
        _, first = np.unique(slot[todo], return_index=True)
        mine = todo[first][keys[slot[todo[first]]] < 0]
        keys[slot[mine]], values[slot[mine]] = key[mine], value[mine]
        todo = np.setdiff1d(todo, mine)
        slot[todo] = (slot[todo] + 1) & (size - 1)
    return keys, values


@dataclass
class Transducer:
    """`arcs`: cost and id of each piece; `trie`: the same as arrays, which are all that encoding needs."""

    arcs: dict[str, tuple[float, int]]
    byte_ids: list[int]
    byte_cost: float
    texts: list[bytes]
    per_word: bool = False  # no piece goes on from another sign into a space, or holds a newline
    trie: Trie | None = None

    def __getstate__(self):
        return vars(self) | {"arcs": {}}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(data: bytes) -> tuple[list[tuple[str, float, int]], dict[int, bytes | int], bool]:
    """(piece, score, type) of each id, the normaliser's fields, and whether it is a BPE model."""
    pieces, normaliser, trainer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            score = float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0
            pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    return pieces, normaliser, trainer.get(3, 1) == 2


def compile_transducer(data: bytes) -> Transducer:
    """Transducer of a model with byte fallback and without a character map.

    Costs are negated scores, moved so that the least is 0. Scores of a BPE model are no
    logarithms but merge ranks: there, the cost is the logarithm of the rank (Zipf's law).
    A piece that other pieces spell at less cost lies on no best path and is left out. If
    no piece left goes from another sign into a space or holds a newline, the lattice falls
    apart in front of spaces and around newlines, and words are encoded one by one.
    """
    pieces, normaliser, is_bpe = read_model(data)
    if normaliser.get(2) or normaliser.get(4, 1):
        raise ValueError("the normaliser must keep text as it is: no character map, no removed spaces")
    byte_ids = [i for i, p in enumerate(pieces) if p[2] == BYTE]
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    normal = sorted((-s, i, p) for i, (p, s, kind) in enumerate(pieces) if kind == NORMAL and p)
    arcs = {p: (math.log(2 + k) if is_bpe else c - normal[0][0], i) for k, (c, i, p) in enumerate(normal)}
    texts = [p.replace(SPACE, " ").encode() if k == NORMAL else b"" for p, _, k in pieces]
    for value, i in enumerate(byte_ids):
        texts[i] = bytes([value])
    byte_cost = max(c for c, _ in arcs.values()) + BYTE_PENALTY
    states = _states(arcs)
    for p in sorted((p for p in arcs if SPACE in p[1:]), key=len):
        cost, i = arcs[p]
        more = states[p][2]
        states[p] = 0.0, -1, more
        if least_cost(states, byte_cost, p) < cost:
            del arcs[p]
        else:
            states[p] = cost, i, more
    per_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in arcs)
    return Transducer(arcs, byte_ids, byte_cost, texts, per_word, Trie.build(arcs))


def _states(arcs: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int, bool]]:
    """The trie of the pieces, its states named by their strings."""
    inner = {p[:k] for p in arcs for k in range(1, len(p))}
    return {p: (*arcs.get(p, (0.0, -1)), p in inner) for p in inner | arcs.keys()}


def least_cost(states: dict[str, tuple[float, int, bool]], byte_cost: float, text: str) -> float:
    """Cost of the cheapest path through the lattice of a short normalised text."""
    n = len(text)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        at = states.get(text[i])
        if at is None or at[1] < 0:
            best[i + 1] = min(best[i + 1], best[i] + byte_cost * len(text[i].encode()))
        j = i + 1
        while at is not None:
            best[j] = min(best[j], best[i] + at[0]) if at[1] >= 0 else best[j]
            j += 1
            at = states.get(text[i:j]) if j <= n else None
    return best[n]


class Lattices:
    """The lattices of words, swept together.

    `text` holds the characters of all words, longest word first. A node is a place in a word, from in front of its
    first character to behind its last one. `came` and `by` have the length and the id (-1: bytes) of the
    last step of the best path to a node. Of paths of equal cost, the one whose last piece is longest is taken, and
    so on towards the front.
    """

    def __init__(self, machine: Transducer, text: np.ndarray, length: np.ndarray):
        self.machine, self.trie, self.text, self.length = machine, machine.trie, text, length
        self.start = np.cumsum(length) - length
        self.node = self.start + np.arange(len(length))
        self.chars = self.trie.classes[self.text]
        # A character's bytes in UTF-8.
        self.size = np.int8(1) + (self.text > 0x7F) + (self.text > 0x7FF) + (self.text > 0xFFFF)
        n = len(text) + len(length)
        self.best = np.full(n, np.inf)
        self.best[self.node] = 0.0
        self.came, self.by = np.zeros(n, np.int32), np.full(n, -1, np.int32)

    def sweep(self) -> None:
        """All words, place by place."""
        for place in range(int(self.length[0]) if len(self.length) else 0):
            n = int(np.searchsorted(-self.length, -place))
            here = self.best[self.node[:n] + place]
            at = self.start[:n] + place
            state = self.trie.root[self.chars[at]]
            live = np.flatnonzero(self.trie.piece[state] < 0)
            self._step(live, here[live] + self.machine.byte_cost * self.size[at[live]], place, 1, np.full(len(live), -1, np.int32))
            live, step = np.flatnonzero(state), 1
            state = state[live]
            while len(live):
                self._step(live, here[live] + self.trie.cost[state], place, step, self.trie.piece[state])
                on = self.length[live] > place + step
                live, state = live[on], state[on]
                state = self.trie.follow(state, self.chars[self.start[live] + place + step])
                on = state > 0
                live, state, step = live[on], state[on], step + 1

    def _step(self, live: np.ndarray, cost: np.ndarray, place: int, step: int, piece: np.ndarray) -> None:
        to = self.node[live] + place + step
        less = cost < self.best[to]
        to = to[less]
        self.best[to], self.came[to], self.by[to] = cost[less], step, piece[less]

    def sweep_one(self) -> None:
        """A single long word: all places walk down the trie together, then the arcs are taken in order."""
        n = len(self.text)
        state = self.trie.root[self.chars]
        bare = np.flatnonzero(self.trie.piece[state] < 0)
        arcs = [(bare, np.ones(len(bare), np.int64), self.machine.byte_cost * self.size[bare], np.full(len(bare), -1))]
        live, step = np.flatnonzero(state), 1
        state = state[live]
        while len(live):
            ends = self.trie.piece[state] >= 0
            arcs.append((live[ends], np.full(ends.sum(), step), self.trie.cost[state[ends]], self.trie.piece[state[ends]]))
            on = live + step < n
            live, state = live[on], state[on]
            state = self.trie.follow(state, self.chars[live + step])
            on = state > 0
            live, state, step = live[on], state[on], step + 1
        start, step, cost, piece = (np.concatenate(x) for x in zip(*arcs))
        order = np.lexsort((step, start))
        best, came, by = [0.0] + [math.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i, k, c, p in zip(*(x[order].tolist() for x in (start, step, cost, piece))):
            c += best[i]
            if c < best[i + k]:
                best[i + k], came[i + k], by[i + k] = c, k, p
        self.best, self.came, self.by = np.array(best), np.array(came, np.int32), np.array(by, np.int32)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        at, word = self.node + self.length, np.arange(len(self.length))
        nodes, words = [at[:0]], [word[:0]]
        while True:
            going = at > self.node[word]
            at, word = at[going], word[going]
            if not len(at):
                break
            nodes.append(at)
            words.append(word)
            at = at - self.came[at]
        nodes, words = np.concatenate(nodes), np.concatenate(words)
        order = np.argsort(nodes)
        nodes, words = nodes[order], words[order]
        ids = self.by[nodes].copy()
        sizes = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            codes = self.text[nodes[bare] - 1 - words[bare]]
            sizes[bare] = self.size[nodes[bare] - 1 - words[bare]]
            flat = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            of_bytes = np.repeat(ids < 0, sizes)
            ids = np.repeat(ids, sizes)
            ids[of_bytes] = np.array(self.machine.byte_ids, np.int32)[flat]
        return ids, np.bincount(words, sizes, len(self.length)).astype(np.int64)


def encode_words(machine: Transducer, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, in which spaces are spaces, one after the other, and how many each has."""
    length = pc.utf8_length(words).to_numpy().astype(np.int64)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.take(pa.array(order))), "")[0].as_py()
    text = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n_long = int(np.searchsorted(-length, -LONG))
    ends, found = np.cumsum(length), []
    for k in range(n_long):
        lattice = Lattices(machine, text[ends[k] - length[k] : ends[k]], length[k : k + 1])
        lattice.sweep_one()
        found.append(lattice.paths())
    lattices = Lattices(machine, text[ends[n_long - 1] if n_long else 0 :], length[n_long:])
    lattices.sweep()
    found.append(lattices.paths())
    ids, sizes = (np.concatenate(x) for x in zip(*found))
    back = np.empty(len(words), np.int64)
    back[order] = np.arange(len(words))
    return chosen_lists(ids, sizes, back), sizes[back]


def encode_texts(machine: Transducer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts without null one after the other, and how many each has. Empty texts have none."""
    begun = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    if not machine.per_word:
        lists = [[t] if t else [] for t in begun.to_pylist()]
    elif pc.any(pc.match_substring(begun, BETWEEN)).as_py():
        lists = [PARTS.findall(t) for t in begun.to_pylist()]
    else:
        parted = pc.replace_substring(begun, "\n", f"{BETWEEN}\n{BETWEEN}")
        lists = pc.split_pattern(pc.replace_substring_regex(parted, "( +)", BETWEEN + r"\1"), BETWEEN)
    if isinstance(lists, list):
        lists = pa.array(lists, pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    ids, sizes = encode_words(machine, words.dictionary)
    chosen = words.indices.to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes[chosen])])
    last = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return chosen_lists(ids, sizes, chosen), np.diff(ends[last])


def decode_ids(machine: Transducer, ids: list[int]) -> str:
    """Text of ids: pieces and bytes one after the other, without the dummy space.

    Bytes that are no UTF-8 become U+FFFD; ids of control pieces give nothing.
    """
    texts = machine.texts
    data = b"".join([texts[i] for i in ids])
    return data.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compiled(data: bytes) -> Transducer:
    return compile_transducer(data)


def _broadcast(docs: DataFrame, model_path: str):
    """The compiled model: as large as the vocabulary, whatever the documents are."""
    with open(model_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(_compiled(f.read()))


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL_PATH, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with ids (array<int>) and n_tokens (long).

    Null and empty texts have no ids. A U+2581 in a text is spelled in bytes, so that it comes back.
    Columns of these names are replaced, others carried. A narrow pass: the model is broadcast, and a
    task holds the different words of GROUP_BYTES of texts, or of one longer text.
    """
    machine = _broadcast(docs, model_path)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = []
        for group in byte_groups(batch.column(text_col).fill_null(""), GROUP_BYTES):
            ids, counts = encode_texts(machine.value, group)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
        ids = pa.concat_arrays(lists)
        return [ids, ids.value_lengths().cast(pa.int64())]

    return add_columns(docs, "ids array<int>, n_tokens bigint", fn, drop=drop)


def decode(tokens: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = MODEL_PATH, digest: bool = False) -> DataFrame:
    """tokens with the decoded text of ids, or with the SHA-256 of it; null ids give an empty text."""
    machine = _broadcast(tokens, model_path)

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(ids_col)
        flat = np.asarray(column.flatten())
        ends = np.cumsum([n or 0 for n in column.value_lengths().to_pylist()]).tolist()
        texts = [decode_ids(machine.value, flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
        if digest:
            return [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())]
        return [pa.array(texts, pa.string())]

    return add_columns(tokens, f"{out_col} string", fn)
