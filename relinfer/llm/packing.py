"""Packing (12): vector bin packing of token lists by the dot-product heuristic.

A sequence has room for tokens, segments and loss-bearing tokens. The next segment is the waiting
example that fits and whose demand has the greatest dot product with the room that is left, both in
units of the limits. Where none fits, one is cut to fill the room, and the rest of it goes on waiting.
Every partition packs its own rows in one pass, over a window of waiting examples.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from relinfer.llm.common import add_columns, byte_groups, chosen_lists

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
END_ID = 1
# Examples that wait in a task to be chosen from.
WINDOW = 512
# Bytes of texts that are tokenized together, and new plain words that are merged at once.
GROUP_BYTES = 1 << 22
MERGED_WORDS = 8192
# Sequences of a task are numbered from its partition's number times this.
SEQUENCES = 1 << 33


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the tokenizer cuts a text into words, each of which has ids of its own.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# Latin letters that are whole by themselves and have one lower-case letter. A word of them, in lower
# case, stays as it is until its letters are merged.
PLAIN = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+"


class WordTokenizer:
    """Ids of texts by a word tokenizer that lower-cases, drops white space and cuts by PRE_TOKENS.

    Texts are cut at spaces and newlines; other white space is left to the tokenizer. Signs behind a plain
    word are words of their own. Each different word of a group of texts is encoded once: plain ones as one
    list by the merges alone, the others one by one by the whole tokenizer.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = json.loads(model)
        steps = [p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if [p["pattern"]["Regex"] for p in steps] != [PRE_TOKENS] or made["model"]["end_of_word_suffix"] != WORD_END:
            raise ValueError("the tokenizer cuts words in another way")
        self.tokenizer = Tokenizer.from_str(model)
        made |= {"normalizer": None, "added_tokens": []}
        made["pre_tokenizer"]["pretokenizers"] = [
            {"type": "WhitespaceSplit"}, *(p for p in made["pre_tokenizer"]["pretokenizers"] if p["type"] != "Split")
        ]
        self.merges = Tokenizer.from_str(json.dumps(made))
        vocabulary = self.merges.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        part, parts = self._parts(words.dictionary)
        flat, sizes = self._learn(parts)
        chosen = part[words.indices.to_numpy()].ravel()
        ends = np.cumsum(sizes[chosen])
        last = 2 * np.cumsum(lists.value_lengths().to_numpy()) - 1
        return chosen_lists(flat, sizes, chosen), np.diff(np.concatenate([[0], ends[last]]))

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the two parts of each word: a plain word in lower case and the signs behind it, or all and nothing."""
        core = pc.utf8_rtrim(words, characters=string.punctuation)
        plain = pc.match_substring_regex(core, PLAIN + "$")
        first = pc.if_else(plain, pc.utf8_lower(core), words)
        second = pc.if_else(plain, pc.replace_substring_regex(words, PLAIN, ""), "")
        both = pa.concat_arrays([first, second]).dictionary_encode()
        return both.indices.to_numpy().reshape(2, -1).T, both.dictionary

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and how many each has."""
        plain = pc.match_substring_regex(parts, PLAIN + "$").to_numpy(zero_copy_only=False)
        words = parts.filter(pa.array(plain))
        joined = (" ".join(words.slice(k, MERGED_WORDS).to_pylist()) for k in range(0, max(1, len(words)), MERGED_WORDS))
        found = np.concatenate([
            np.array(self.merges.encode_batch_fast([j], add_special_tokens=False)[0].ids, np.uint32) for j in joined
        ])
        other = [x.ids for x in self.tokenizer.encode_batch_fast(parts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        sizes = np.zeros(len(parts), np.int64)
        sizes[plain] = np.diff(np.concatenate([[0], np.flatnonzero(self.ends[found]) + 1]))
        sizes[~plain] = [len(x) for x in other]
        flat = np.zeros(sizes.sum(), np.uint32)
        of_plain = np.repeat(plain, sizes)
        flat[of_plain] = found
        flat[~of_plain] = np.fromiter(chain.from_iterable(other), np.uint32)
        return flat, sizes


def tokenize(
    docs: DataFrame, text_col: str = "text", model_path: str | None = None, end_id: int | None = END_ID,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """docs with `ids` (array<int>), the tokens of the whole text and `end_id`; a narrow pass.

    Null is an empty text, which has the end only. A column named ids is replaced. The model file is
    read on the driver and broadcast; its size is the vocabulary's.
    """
    with open(model_path or tokenizer_path(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    # One for each task.
    made: list[WordTokenizer] = []

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(WordTokenizer(model.value))
        lists = []
        for group in byte_groups(batch.column(text_col).fill_null(""), GROUP_BYTES):
            flat, counts = made[0].encode(group)
            flat = flat.astype(np.int32)
            if end_id is not None:
                flat = np.insert(flat, np.cumsum(counts), end_id)
                counts = counts + 1
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        return [pa.concat_arrays(lists)]

    return add_columns(docs, "ids array<int>", fn, drop=drop)


@dataclass
class Example:
    """What still waits of a row: its tokens from `start` on, and before which of them how many bear loss."""

    key: object
    ids: np.ndarray
    loss: np.ndarray  # running count of loss-bearing tokens, from 0, one longer than ids
    start: int = 0

    @property
    def left(self) -> int:
        return len(self.ids) - self.start

    @property
    def loss_left(self) -> int:
        return int(self.loss[-1] - self.loss[self.start])

    def prefix(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix of what is left within the limits."""
        until = int(np.searchsorted(self.loss, self.loss[self.start] + loss, "right")) - 1
        return min(tokens, until - self.start, self.left)


def _good(length: int, limit: int) -> bool:
    """A sequence of this length needs no padding."""
    return length == limit or length & (length - 1) == 0


class Packer:
    """Packs examples as they come; sequences are lists of (example, start, length)."""

    def __init__(self, limits: Limits, window: int = WINDOW):
        self.limits, self.window = limits, window
        self.waiting: list[Example] = []
        self.demand = np.zeros((0, 2))
        self.unit = np.array([limits.tokens, limits.loss], float)

    def add(self, examples: list[Example]) -> Iterator[list[tuple[Example, int, int]]]:
        for example in examples:
            while example.left > self.limits.tokens or example.loss_left > self.limits.loss:
                length = example.prefix(self.limits.tokens, self.limits.loss)
                if not _good(length, self.limits.tokens):
                    length = 1 << (length.bit_length() - 1)
                yield [(example, example.start, length)]
                example.start += length
            if example.left:
                self._wait(example)
            if len(self.waiting) >= 2 * self.window:
                while len(self.waiting) > self.window:
                    yield self._sequence()

    def finish(self) -> Iterator[list[tuple[Example, int, int]]]:
        while self.waiting:
            yield self._sequence()

    def _wait(self, example: Example) -> None:
        n = len(self.waiting)
        if n >= len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros((max(64, n), 2))])
        self.waiting.append(example)
        self.demand[n] = example.left, example.loss_left

    def _take(self, at: int) -> Example:
        """Remove an example; the last one takes its place."""
        example, last = self.waiting[at], self.waiting.pop()
        if last is not example:
            self.waiting[at] = last
            self.demand[at] = self.demand[len(self.waiting)]
        return example

    def _sequence(self) -> list[tuple[Example, int, int]]:
        room, pieces = [self.limits.tokens, self.limits.loss], []
        while self.waiting and room[0] and len(pieces) < self.limits.segments:
            demand = self.demand[: len(self.waiting)]
            # The demand of one segment is the same for all and changes no choice.
            value = demand @ (np.array(room) / self.unit**2)
            fits = (demand[:, 0] <= room[0]) & (demand[:, 1] <= room[1])
            if fits.any():
                example = self._take(int(np.where(fits, value, -1.0).argmax()))
                length = example.left
            else:
                at, length = self._longest_prefix(room, value)
                if not length:
                    break
                example = self._take(at)
            pieces.append((example, example.start, length))
            room[0] -= length
            room[1] -= int(example.loss[example.start + length] - example.loss[example.start])
            example.start += length
            if example.left and room[0]:
                # Cut because of the loss: it can't go on in this sequence.
                return self._closed(pieces, example)
            if example.left:
                self._wait(example)
        return self._closed(pieces)

    def _longest_prefix(self, room: list[int], value: np.ndarray) -> tuple[int, int]:
        """The example of which most fits into the room, of equals the one of greatest value; and how much."""
        demand = self.demand[: len(self.waiting)]
        # Not more than the room, and where all tokens bear loss, not more than the room for those.
        most = np.minimum(demand[:, 0], np.where(demand[:, 0] == demand[:, 1], min(room), room[0]))
        at, length = -1, 0
        for k in np.lexsort((-value, -most)):
            if most[k] <= length:
                break
            found = self.waiting[k].prefix(*room)
            if found > length:
                at, length = int(k), found
        return at, length

    def _closed(self, pieces: list[tuple[Example, int, int]], rest: Example | None = None) -> list[tuple[Example, int, int]]:
        """The sequence, shortened to a power of two where it would be padded; what is cut off waits on."""
        if rest is not None:
            self._wait(rest)
        total = sum(p[2] for p in pieces)
        if _good(total, self.limits.tokens):
            return pieces
        surplus = total - (1 << (total.bit_length() - 1))
        while surplus:
            example, start, length = pieces.pop()
            off = min(surplus, length)
            surplus -= off
            at = next((k for k, e in enumerate(self.waiting) if e is example), None)
            if at is not None:
                self._take(at)
            example.start = start + length - off
            self._wait(example)
            if off < length:
                pieces.append((example, start, length - off))
        return pieces


def pack(
    examples: DataFrame, ids_col: str = "ids", id_col: str = "doc_id", loss_col: str | None = None,
    limits: Limits = Limits(), window: int = WINDOW, digest: bool = False,
) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids) of token lists in sequences.

    `loss_col` (array<boolean>, as long as the ids; null or too short: false) tells which tokens bear loss;
    without it all do. Every token lies in one piece, and the pieces of a sequence follow one another from offset 0. No sequence
    exceeds a limit; its length is the limit or a power of two, so none is padded. Null and empty lists have no
    piece, null ids are carried, equal rows are rows of their own, other columns are not carried.

    With `digest` there is ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) in place of ids. A
    narrow pass: a task holds the tokens of at most 2 * window waiting rows and of its Arrow batch, and
    the last rows of each partition end in at most one sequence for each power of two.
    """
    last = ("ids_crc32", T.LongType()) if digest else ("ids", T.ArrayType(T.IntegerType()))
    kind = examples.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")),
        T.StructField(*last),
    ])

    def read(batch: pa.RecordBatch) -> Iterator[Example]:
        keys, lists = batch.column(id_col), batch.column(ids_col)
        for k in range(batch.num_rows):
            ids = lists[k].values
            if ids is None or not len(ids):
                continue
            ids = ids.to_numpy(zero_copy_only=False).astype(np.uint32)
            bears = np.ones(len(ids), np.int64)
            if loss_col is not None:
                given = (batch.column(loss_col)[k].as_py() or [])[: len(ids)]
                bears[:] = 0
                bears[: len(given)] = [bool(x) for x in given]
            yield Example(keys[k], ids, np.concatenate([[0], np.cumsum(bears)]))

    def rows(sequences, number: int) -> tuple[list[tuple], int]:
        out = []
        for pieces in sequences:
            offset = 0
            for example, start, length in pieces:
                ids = example.ids[start : start + length]
                out.append((example.key, start, length, len(example.ids), number, offset, zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids))
                offset += length
            number += 1
        return out, number

    def table(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*found))
        last_type = pa.int64() if digest else pa.list_(pa.int32())
        values = columns[6] if digest else [x.astype(np.int32) for x in columns[6]]
        return pa.RecordBatch.from_arrays([
            pa.array([x.as_py() for x in columns[0]], id_type), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(list(values), last_type),
        ], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number, id_type = Packer(limits, window), TaskContext.get().partitionId() * SEQUENCES, None
        for batch in batches:
            id_type = batch.schema.field(id_col).type
            found, number = rows(packer.add(read(batch)), number)
            if found:
                yield table(found, id_type)
        found, number = rows(packer.finish(), number)
        if found:
            yield table(found, id_type)

    return examples.select(id_col, ids_col, *([loss_col] if loss_col else [])).mapInArrow(run, schema)
