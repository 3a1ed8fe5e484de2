"""Arrow kernels for the two operations whose cost is in multiply-adds.

Each works on the batches Spark hands it, with no state of its own; Spark
partitions, groups and shuffles the rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

# Ship the kernels with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _offsets(lengths: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))


def _vectors(matrix: np.ndarray, valid: np.ndarray) -> pa.ListArray:
    """Rows of `matrix` as vectors at the valid places, null elsewhere."""
    offsets = _offsets(np.where(valid, matrix.shape[1] if matrix.ndim == 2 else 0, 0))
    return pa.ListArray.from_arrays(
        offsets, pa.array(matrix.ravel(), pa.float64()), mask=pa.array(~valid)
    )


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Non-null vectors of equal length as the rows of a matrix."""
    n = len(vectors) - vectors.null_count
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _once(kernel):
    """Keep the optimizer from copying a call into a filter below it."""
    return kernel.asNondeterministic()


def matmul_kernel(weights):
    """UDF (x, size of x) -> W x for a broadcast matrix W of shape (out, in)."""

    @F.arrow_udf("array<double>")
    def matmul(x: pa.Array, width: pa.Array) -> pa.Array:
        w = weights.value
        valid = np.asarray(x.is_valid())
        if np.any(np.asarray(width)[valid] != w.shape[1]):
            raise ValueError(f"the matrix takes vectors of length {w.shape[1]}")
        rows = _matrix(x)
        return _vectors(rows @ w.T if len(rows) else np.zeros((0, w.shape[0])), valid)

    return _once(matmul)


def gather_kernel(table):
    """UDF id -> row of a broadcast matrix; null for an id that it doesn't have."""

    @F.arrow_udf("array<double>")
    def gather(ids: pa.Array) -> pa.Array:
        w = table.value
        at = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        valid = (at >= 0) & (at < len(w))
        return _vectors(w[at[valid]], valid)

    return _once(gather)


def _with(batch, columns, without=()):
    """The batch with some columns replaced or added, and without others."""
    given = {n: batch.column(n) for n in batch.schema.names if n not in without} | columns
    return pa.RecordBatch.from_arrays(list(given.values()), list(given))


def _width(rows, w):
    if len(rows) and rows.shape[1] != w:
        raise ValueError(f"the matrix takes vectors of length {w}")
    return rows if len(rows) else np.zeros((0, w))


def gather_step(table, ids: str, out: str):
    """mapInArrow function adding the rows of a broadcast matrix; an id that it doesn't have is an error."""

    def run(batches):
        for batch in batches:
            w, named = table.value, batch.column(ids)
            at = named.fill_null(-1).to_numpy(zero_copy_only=False)
            valid = (at >= 0) & (at < len(w))
            if not valid.all():
                unknown = named[int(np.argmin(valid))].as_py()
                raise ValueError(f"no embedding for token {'null' if unknown is None else unknown}")
            yield _with(batch, {out: _vectors(w[at], valid)})

    return run


def projection_step(config, gain: np.ndarray, matrices: dict, frequencies: list[float]):
    """mapInArrow function: the norm of x times each matrix {column: broadcast matrix}; q and k are turned by their position."""
    freq, half = np.asarray(frequencies), config.head_dim // 2

    def turned(y, cos, sin):
        pairs = y.reshape(len(y), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        return np.stack([a * cos - b * sin, b * cos + a * sin], 2).reshape(y.shape)

    def run(batches):
        for batch in batches:
            x = batch.column("x")
            valid = np.asarray(x.is_valid())
            rows = _width(_matrix(x), len(gain))
            normed = rows * (1.0 / np.sqrt((rows * rows).sum(1) / len(gain) + config.rms_eps))[:, None] * gain
            angle = (_places(batch)[valid].astype(np.float64)[:, None] * freq)[:, None]
            cos, sin = np.cos(angle), np.sin(angle)
            made = {}
            for name, sent in matrices.items():
                y = normed @ sent.value.T
                made[name] = _vectors(turned(y, cos, sin) if name in "qk" else y, valid)
            yield _with(batch, made)

    return run


def residual_step(sent, o: str = "o", x: str = "x"):
    """mapInArrow function: x + W o for a broadcast matrix W, without `o`; a missing o counts as zero."""

    def run(batches):
        for batch in batches:
            w, old = sent.value, np.asarray(batch.column(x).is_valid())
            rows, valid = _matrix(batch.column(x)), np.asarray(batch.column(o).is_valid())[old]
            rows = np.array(rows)
            if valid.any():
                rows[valid] += _width(_matrix(batch.column(o).filter(pa.array(old))), w.shape[1]) @ w.T
            yield _with(batch, {x: _vectors(rows, old)}, [o])

    return run


def chained(steps):
    """mapInArrow function of steps one after the other, each on what the one before it gives."""

    def run(given):
        for step in steps:
            given = step(given)
        return given

    return run


# Scores of a part of the queries that are worked on at once: few enough for a processor's cache.
PART_SCORES, PART_QUERIES = 1 << 17, (8, 64)


def _parts(seen, heads: int):
    """Slices of queries whose scores over the keys they see (ascending numbers) are few."""
    start = int(np.searchsorted(seen, 1))
    while start < len(seen):
        least, most = PART_QUERIES
        size = max(least, min(most, PART_SCORES // (heads * int(seen[start]))))
        yield slice(start, min(start + size, len(seen)))
        start += size


def _hide(s, seen, value):
    """Put `value` in place of the scores (.., query, head of the group, key) of keys that a query doesn't see."""
    first = int(seen[0])
    if first < s.shape[-1]:
        np.copyto(s[..., first:], value, where=(np.arange(first, s.shape[-1]) >= seen[:, None])[:, None])


class _Keys:
    """Places, keys (kv head, component, key) and values (kv head, key, component) of a batch."""

    def __init__(self, batch, n_kv, head_dim):
        self.places = _places(batch)
        n = len(self.places)
        self.k = np.ascontiguousarray(_matrix(batch.column("k")).reshape(n, n_kv, head_dim).transpose(1, 2, 0))
        self.v = None
        if "v" in batch.schema.names:
            self.v = np.ascontiguousarray(_matrix(batch.column("v")).reshape(n, n_kv, head_dim).transpose(1, 0, 2))

    def far(self, q, clamp):
        """Whether two scores of a query may differ by more than the clamp."""
        longest = lambda x, axis: np.sqrt((x * x).sum(axis).max(initial=0.0))
        return not 2 * longest(q, -1) * longest(self.k, 1) < clamp


def _heads(rows, shape):
    """Scaled queries (kv head, query, head of the group, component)."""
    n_kv, head_dim, scale = shape
    q = _matrix(rows.column("q")).reshape(rows.num_rows, n_kv, -1, head_dim)
    return np.ascontiguousarray(q.transpose(1, 0, 2, 3)) * scale


def _dot(q, k):
    """Scores (.., query, head of the group, key)."""
    n, group, dim = q.shape[-3:]
    return (q.reshape(*q.shape[:-3], n * group, dim) @ k).reshape(*q.shape[:-1], -1)


def _mixed(e, v):
    n, group, keys = e.shape[-3:]
    return (e.reshape(*e.shape[:-3], n * group, keys) @ v).reshape(*e.shape[:-1], -1)


def _exponents(s, top, seen, clamp, far):
    """exp(s - top), not below e^-clamp and 0 for hidden keys, which are -inf; in place."""
    s -= top[..., None]
    if far:
        np.maximum(s, -clamp, out=s)
    np.exp(s, out=s)
    if far:
        _hide(s, seen, 0.0)
    return s


class _Tile:
    """Causal grouped-query attention of the queries of a unit of work; their own keys first, then others batch by batch.

    Exponents are taken relative to the maximum so far and rescaled when it rises. The clamp is applied to each
    batch; a weight that it lifts, e^-clamp of the maximum, is below the resolution of the sum. Positions ascend; of rows that
    come twice, a query sees those up to the end of its block of `size` rows.
    """

    def __init__(self, rows, shape, size):
        self.rows = _one(rows)
        self.n_kv, self.dim, scale, self.clamp = shape
        self.pos, self.q = _places(self.rows), _heads(self.rows, shape[:3])
        self.top = np.full(self.q.shape[:3], -np.inf)
        self.total, self.mixed, self.far = np.zeros(self.q.shape[:3]), np.zeros(self.q.shape), False
        self.add(self.rows, (np.arange(len(self.pos)) // size + 1) * size)

    def add(self, batch, limit=None):
        keys = _Keys(batch, self.n_kv, self.dim)
        seen = np.searchsorted(keys.places, self.pos, "right")
        seen = seen if limit is None else np.minimum(seen, limit)
        self.far = self.far or keys.far(self.q, self.clamp)
        for own in _parts(seen, self.q.shape[2]):
            n = int(seen[own.stop - 1])
            for h in range(self.n_kv):
                s = _dot(self.q[h, own], keys.k[h, :, :n])
                _hide(s, seen[own], -np.inf)
                old = self.top[h, own]
                top = np.maximum(old, s.max(-1))
                fade = np.exp(old - top)
                e = _exponents(s, top, seen[own], self.clamp, self.far)
                self.total[h, own] = self.total[h, own] * fade + e.sum(-1)
                self.mixed[h, own] = self.mixed[h, own] * fade[..., None] + _mixed(e, keys.v[h, :n])
                self.top[h, own] = top

    def result(self, kept, out):
        """A row of concatenated heads per query; zero where a query saw no key."""
        total = np.where(self.total > 0, self.total, 1.0)
        o = (self.mixed / total[..., None]).transpose(1, 0, 2, 3).reshape(len(self.pos), -1)
        o = _vectors(o, np.ones(self.rows.num_rows, bool))
        return pa.RecordBatch.from_arrays([*(self.rows.column(c) for c in kept), o], [*kept, out])


def _runs(batch, names):
    """Ends of the runs of rows that are equal in the columns, nulls being equal."""
    differ = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        a, b = batch.column(name)[:-1], batch.column(name)[1:]
        differ |= np.asarray(pc.not_equal(a, b).fill_null(False)) | np.asarray(pc.xor(a.is_null(), b.is_null()))
    return [*(np.flatnonzero(differ) + 1).tolist(), batch.num_rows]


def attention_kernel(config, units: list[str], kept: list[str], out: str, size: int):
    """mapInArrow function over rows sorted by (units, _kind, pos).

    Rows of kind 0 are the queries of a unit, with all columns and with their own keys and values; rows of
    kind 1 bring those of other positions. Gives the query rows with `kept` columns and `out`. A unit
    without queries gives nothing.
    """
    shape = config.n_kv_heads, config.head_dim, config.score_scale, config.exp_clamp

    def run(batches):
        now, rows, tile = None, [], None
        for batch in batches:
            start = 0
            for end in _runs(batch, [*units, "_kind"]) if batch.num_rows else []:
                part = batch.slice(start, end - start)
                start = end
                unit = tuple(part.column(c)[0].as_py() for c in units)
                if unit != now:
                    if rows:
                        yield (tile or _Tile(rows, shape, size)).result(kept, out)
                    now, rows, tile = unit, [], None
                if part.column("_kind")[0].as_py() == 0:
                    rows.append(part)
                elif rows:
                    tile = tile or _Tile(rows, shape, size)
                    tile.add(part)
        if rows:
            yield (tile or _Tile(rows, shape, size)).result(kept, out)

    return run


def _pairs(batches, units):
    """(rows of kind 0 of a unit, some of its rows of kind 1), of rows sorted by (units, _kind, ..)."""
    now, held, block = None, [], None
    for batch in batches:
        start = 0
        for end in _runs(batch, [*units, "_kind"]) if batch.num_rows else []:
            part = batch.slice(start, end - start)
            start = end
            unit = tuple(part.column(c)[0].as_py() for c in units)
            if unit != now:
                now, held, block = unit, [], None
            if part.column("_kind")[0].as_py() == 0:
                held.append(part)
            elif held:
                block = block or pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield block, part


def _places(batch):
    return batch.column("pos").to_numpy(zero_copy_only=False)


def _tiles(batches, units):
    """(rows of kind 0 of a unit as one batch, (kind, batch) of its other rows), of rows sorted by (units, _kind, pos)."""
    now, held, later = None, [], []
    for batch in batches:
        start = 0
        for end in _runs(batch, [*units, "_kind"]) if batch.num_rows else []:
            part = batch.slice(start, end - start)
            start = end
            unit = tuple(part.column(c)[0].as_py() for c in units)
            kind = part.column("_kind")[0].as_py()
            if unit != now:
                if held and not later:
                    yield _one(held), None
                now, held, later = unit, [], []
            if kind == 0:
                held.append(part)
            elif held:
                later = later or [_one(held)]
                yield later[0], (kind, part)
    if held and not later:
        yield _one(held), None


def _one(batches):
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _present(batches, key):
    """Batches without the rows whose key is null."""
    for batch in batches:
        yield batch.filter(batch.column(key).is_valid()) if batch.column(key).null_count else batch


class _ScoreTile:
    """The queries of a tile, which meet its own keys, and those of earlier tiles, which come in batches."""

    def __init__(self, rows, config, unit):
        self.rows, self.config, self.unit = rows, config, unit
        self.pos, self.q = _places(rows), _heads(rows, (config.n_kv_heads, config.head_dim, config.score_scale))
        self.top, self.total = np.full(self.q.shape[:3], -np.inf), np.zeros(self.q.shape[:3])
        # Rows of equal places are one query, as they are in a grouping.
        self.starts = np.flatnonzero(np.r_[True, self.pos[1:] != self.pos[:-1]])
        self.repeats = len(self.starts) < len(self.pos)

    def keys(self, batch):
        return _Keys(batch, self.config.n_kv_heads, self.config.head_dim)

    def meetings(self, keys, spans):
        """Scores of all queries over the keys that they see, of each span (start, end) of keys, in parts."""
        seen, far = np.searchsorted(keys.places, self.pos, "right"), keys.far(self.q, self.config.exp_clamp)
        for a, b in spans:
            inside = np.clip(seen - a, 0, b - a)
            for own in _parts(inside, self.config.n_heads):
                n = int(inside[own.stop - 1])
                s = _dot(self.q[:, own], keys.k[:, :, a : a + n])
                _hide(s, inside[own], -np.inf)
                yield _Scores(self, own, keys, slice(a, a + n), inside[own], s, far)

    def normalise(self, batch):
        """Take a batch of keys into the greatest score and the sum of exponents of every query."""
        keys = self.keys(batch)
        for x in self.meetings(keys, _spans(keys, SPAN_KEYS)):
            top, total, _ = x.partial()
            old = self.top[:, x.own]
            high = np.maximum(old, top)
            self.total[:, x.own] = self.total[:, x.own] * np.exp(old - high) + total * np.exp(top - high)
            self.top[:, x.own] = high

    def finish(self):
        if self.repeats:
            self.top, (self.total,) = self.together(self.top, self.total)

    def together(self, top, *sums):
        """Greatest scores, and sums relative to them, of rows of equal places together, for each of the rows."""
        sizes = np.diff(np.r_[self.starts, len(self.pos)])
        high = np.repeat(np.maximum.reduceat(top, self.starts, axis=1), sizes, axis=1)
        fade = np.exp(top - high)
        added = [x * fade.reshape(*fade.shape, *[1] * (x.ndim - 3)) for x in sums]
        return high, [np.repeat(np.add.reduceat(x, self.starts, axis=1), sizes, axis=1) for x in added]

    def by_head(self, own, key):
        """The columns (key, pos, head) of a row for each head of some queries."""
        n, heads = own.stop - own.start, self.config.n_heads
        at = pa.array(np.repeat(np.arange(own.start, own.stop), heads))
        head = np.tile(np.arange(heads, dtype=np.int32), n)
        return [self.rows.column(key).take(at), self.rows.column("pos").take(at), pa.array(head)]


# Keys that a query meets at once where its greatest score isn't known.
SPAN_KEYS = 4096


def _spans(keys, size):
    return [(a, min(a + size, len(keys.places))) for a in range(0, len(keys.places), size)]


def _block_spans(places, block):
    """Starts and ends of the runs of ascending places that lie in a block."""
    ends = (np.flatnonzero(np.diff(places // block)) + 1).tolist()
    return [*zip([0, *ends], [*ends, len(places)])] if len(places) else []


class _Scores:
    """Scores of some queries of a tile over a span of keys: (kv head, query, head of the group, key).

    Keys that a query doesn't see, those from its `seen` on, have -inf. Steps in one process hand these on; rows are made of
    them at the end.
    """

    def __init__(self, tile, own, keys, span, seen, s, far):
        self.tile, self.own, self.keys, self.span, self.seen, self.s, self.far = tile, own, keys, span, seen, s, far
        self.e, self.weights = None, {}

    def partial(self):
        """Greatest score, sum of exponents relative to it, and the exponents."""
        top = self.s.max(-1)
        e = _exponents(self.s.copy(), top, self.seen, self.tile.config.exp_clamp, self.far)
        return top, e.sum(-1), e

    def softmax(self, clamp):
        tile = self.tile
        e, self.e = self.e, None
        if e is None or clamp != tile.config.exp_clamp:
            e = _exponents(self.s.copy(), tile.top[:, self.own], self.seen, clamp, True)
        e /= tile.total[:, self.own][..., None]
        return e

    def flat(self, x):
        """(kv head, query, head of the group, ..) as rows by query and head."""
        return x.swapaxes(0, 1).reshape(-1, *x.shape[3:])


def scores_step(config, key: str, units: list[str]):
    """Function from rows in tiles to the `_Scores` of all queries of each tile.

    The greatest score and the sum of exponents of a query are known then. The queries of a tile that meets no other keys than its own
    see them all at once; else the keys of earlier tiles come twice, as kind 1 and as kind 2, the first time for those two.
    """

    def run(batches):
        tile, twice = None, 0
        for rows, more in _tiles(_present(batches, key), units):
            if tile is None or rows is not tile.rows:
                if twice:
                    raise ValueError("keys of earlier tiles have to come twice")
                tile, ready = _ScoreTile(rows, config, rows.column(units[1])[0].as_py()), False
                if more is None and not tile.repeats:
                    keys = tile.keys(rows)
                    for x in tile.meetings(keys, [(0, rows.num_rows)]):
                        tile.top[:, x.own], tile.total[:, x.own], x.e = x.partial()
                        yield x
                    continue
                tile.normalise(rows)
            if more is not None and more[0] == 1:
                twice += more[1].num_rows
                tile.normalise(more[1])
                continue
            if not ready:
                tile.finish()
                keys = tile.keys(rows)
                yield from tile.meetings(keys, _spans(keys, SPAN_KEYS))
                ready = True
            if more is not None:
                twice -= more[1].num_rows
                keys = tile.keys(more[1])
                yield from tile.meetings(keys, _spans(keys, SPAN_KEYS))
        if twice:
            raise ValueError("keys of earlier tiles have to come twice")

    return run


def softmax_step(clamp: float, out: str):
    """Function adding the probabilities to `_Scores`."""

    def run(items):
        for x in items:
            x.weights[out] = x.softmax(clamp)
            yield x

    return run


def _first(value, n, kind):
    """A list in the first of n rows, null in the others."""
    offsets = np.full(n + 1, len(value), np.int32)
    offsets[0] = 0
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value, kind), mask=pa.array(np.arange(n) > 0))


def score_rows(key: str, block: int, values: bool):
    """mapInArrow function from `_Scores`: a row of scores for each query, head and block of keys, and columns of weights.

    With `values`, the first row of a run of queries that meet the same block brings the places and the values of
    that block.
    """

    def run(items):
        for x in items:
            tile, heads = x.tile, x.tile.config.n_heads
            there = x.keys.places[x.span]
            for a, b in _block_spans(there, block):
                skip = int(np.searchsorted(x.seen, a, "right"))
                own, seen = slice(x.own.start + skip, x.own.stop), np.minimum(x.seen[skip:], b) - a
                n, places = len(seen) * heads, there[a:b]
                mask = np.repeat(np.arange(b - a) < seen[:, None], heads, axis=0)
                offsets = _offsets(np.repeat(seen, heads))
                shown = [np.broadcast_to(places, mask.shape), *(x.flat(y[:, skip:, :, a:b]) for y in (x.s, *x.weights.values()))]
                kpos, val, *weights = [pa.ListArray.from_arrays(offsets, pa.array(y[mask])) for y in shown]
                columns = [*tile.by_head(own, key), pa.array(np.full(n, places[0] // block, np.int32)), kpos, val]
                names = [key, "pos", "head", "kblock", "kpos", "val", "_tile", "_top", "_total"]
                columns += [pa.array(np.full(n, tile.unit, np.int32)), *(pa.array(x.flat(y[:, own])) for y in (tile.top, tile.total))]
                if values:
                    names += ["_places", "_values"]
                    v = x.keys.v[:, x.span][:, a:b].swapaxes(0, 1)
                    columns += [_first(places.astype(np.int64), n, pa.int64()), _first(v.ravel(), n, pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns, *weights], [*names, *x.weights])

    return run


def summary_step(key: str, weight: str):
    """mapInArrow function from `_Scores`: how many scores a query and head has there, the greatest one, and the greatest weight."""

    def run(items):
        for x in items:
            n = pa.array(np.repeat(x.seen.astype(np.int64), x.tile.config.n_heads))
            tops = [pa.array(x.flat(y.max(-1))) for y in (x.s, x.weights[weight])]
            yield pa.RecordBatch.from_arrays([*x.tile.by_head(x.own, key), n, *tops], [key, "pos", "head", "n", "top", weight])

    return run


def mix_step(key: str, weight: str, out: str):
    """mapInArrow function from `_Scores` with weights: the values that each query and head mixes by them."""

    def result(tile, o):
        own = slice(0, len(tile.pos))
        columns = tile.by_head(own, key)
        if tile.repeats:
            o = np.add.reduceat(o, tile.starts, axis=1)
            first = (tile.starts[:, None] * tile.config.n_heads + np.arange(tile.config.n_heads)).ravel()
            columns = [c.take(pa.array(first)) for c in columns]
        rows = o.swapaxes(0, 1).reshape(-1, o.shape[-1])
        return pa.RecordBatch.from_arrays([*columns, _vectors(rows, np.ones(len(rows), bool))], [key, "pos", "head", out])

    def run(items):
        tile, o = None, None
        for x in items:
            if x.tile is not tile:
                if tile is not None:
                    yield result(tile, o)
                tile, o = x.tile, np.zeros(x.tile.q.shape)
            places, w = x.keys.places[x.span], x.weights[weight]
            if np.any(places[1:] == places[:-1]):
                # Of equal places the last weight and the first value count, as in mix_kernel.
                given, w = w, np.zeros_like(w)
                w[..., np.searchsorted(places, places)] = given
            o[:, x.own] += _mixed(w, x.keys.v[:, x.span])
        if tile is not None:
            yield result(tile, o)

    return run


def softmax_kernel(clamp: float):
    """UDF (scores, greatest score, sum of exponents) -> probabilities."""

    @F.arrow_udf("array<double>")
    def softmax(val: pa.Array, top: pa.Array, total: pa.Array) -> pa.Array:
        sizes = val.value_lengths().to_numpy(zero_copy_only=False)
        e = val.flatten().to_numpy(zero_copy_only=False) - np.repeat(top.to_numpy(zero_copy_only=False), sizes)
        np.clip(e, -clamp, clamp, out=e)
        np.exp(e, out=e)
        e /= np.repeat(total.to_numpy(zero_copy_only=False), sizes)
        return pa.ListArray.from_arrays(_offsets(sizes), pa.array(e))

    return _once(softmax)


class _Merged:
    """Sums (of columns of `values`) by place and head of a unit, relative to the greatest `top` of each."""

    # Rows that are held before equal ones are added up.
    ROWS = 1 << 18

    def __init__(self):
        self.parts, self.held, self.kept = [], 0, 0

    def add(self, pos, head, top, values):
        self.parts.append((pos, head, top, values))
        self.held += len(pos)
        if self.held > self.kept + self.ROWS:
            self.parts = [self.merged()]
            self.held = self.kept = len(self.parts[0][0])

    def merged(self):
        pos, head, top, values = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((head, pos))
        pos, head, top, values = pos[order], head[order], top[order], values[order]
        starts = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (head[1:] != head[:-1])])
        high = np.maximum.reduceat(top, starts)
        fade = np.exp(top - np.repeat(high, np.diff(np.r_[starts, len(pos)])))
        return pos[starts], head[starts], high, np.add.reduceat(values * fade[:, None], starts)


def partials_step(config, key: str, units: list[str], block: int):
    """Function from rows in tiles to what the softmax of each block of keys comes to.

    Of some queries over a block: their `_Scores` with (greatest score, sum of exponents relative to it, the values mixed by
    the exponents), and whether the block is of the tile's own keys.
    """

    def run(batches):
        tile = None
        for rows, more in _tiles(_present(batches, key), units):
            met = [] if more is None or more[0] != 1 else [more[1]]
            if tile is None or rows is not tile.rows:
                tile = _ScoreTile(rows, config, rows.column(units[1])[0].as_py())
                met = [rows, *met]
            for batch in met:
                keys = tile.keys(batch)
                for x in tile.meetings(keys, _block_spans(keys.places, block)):
                    top, total, e = x.partial()
                    yield x, (top, total, _mixed(e, keys.v[:, x.span])), batch is rows

    return run


def partial_rows(key: str, block: int, kept: list[str]):
    """mapInArrow function from partial results: a row for each query, head and block.

    The first row of a query in its own block brings its `kept` columns.
    """

    def run(items):
        for x, (top, total, mixed), own_keys in items:
            tile, heads = x.tile, x.tile.config.n_heads
            at = np.repeat(np.arange(x.own.start, x.own.stop), heads)
            first = (np.arange(len(at)) % heads == 0) & own_keys & (tile.pos[at] // block == x.keys.places[x.span.start] // block)
            at = pa.array(at, mask=~first)
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [*tile.by_head(x.own, key), pa.array(x.flat(top)), pa.array(x.flat(total)), _vectors(x.flat(mixed), np.ones(n, bool)),
                 pa.array(np.full(n, tile.unit, np.int32)), pa.array(first), *(tile.rows.column(c).take(at) for c in kept)],
                [key, "pos", "head", "top", "total", "mixed", "_tile", "_own", *(f"_kept_{c}" for c in kept)],
            )

    return run


def merge_step(kept: list[str], out: str):
    """mapInArrow function from partial results: a row (kept columns, out) for each query."""

    def result(tile, top, total, mixed):
        if tile.repeats:
            _, (total, mixed) = tile.together(top, total, mixed)
        o = (mixed / total[..., None]).swapaxes(0, 1).reshape(len(tile.pos), -1)
        columns = [tile.rows.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, _vectors(o, np.ones(len(o), bool))], [*kept, out])

    def run(items):
        tile, now = None, ()
        for x, (top, total, mixed), _ in items:
            if x.tile is not tile:
                if tile is not None:
                    yield result(tile, *now)
                tile = x.tile
                now = tile.top, tile.total, np.zeros(tile.q.shape)
            tops, totals, sums = now
            old = tops[:, x.own]
            high = np.maximum(old, top)
            before, new = np.exp(old - high), np.exp(top - high)
            totals[:, x.own] = totals[:, x.own] * before + total * new
            sums[:, x.own] = sums[:, x.own] * before[..., None] + mixed * new[..., None]
            tops[:, x.own] = high
        if tile is not None:
            yield result(tile, *now)

    return run


def _units(batches, units):
    """(unit, rows) of each run of a unit."""
    for batch in batches:
        start = 0
        for end in _runs(batch, units) if batch.num_rows else []:
            part = batch.slice(start, end - start)
            start = end
            yield tuple(part.column(c)[0].as_py() for c in units), part


def _heads_of(key, unit, merged, out, key_type, pos_type):
    pos, head, o = merged
    return pa.RecordBatch.from_arrays(
        [pa.array([unit]).cast(key_type).take(pa.array(np.zeros(len(pos), np.int64))), pa.array(pos).cast(pos_type), pa.array(head), _vectors(o, np.ones(len(o), bool))],
        [key, "pos", "head", out],
    )


def merge_kernel(config, key: str, units: list[str], kept: list[str], out: str):
    """mapInArrow function over partial results as partials_kernel leaves them: a row (kept columns, out) for each query."""

    def result(found, rows):
        rows = _one(rows)
        pos, _, _, values = found.merged()
        o = (values[:, :-1] / values[:, -1:]).reshape(-1, config.q_dim)
        at = np.searchsorted(pos[:: config.n_heads], _places(rows))
        columns = [rows.column(f"_kept_{c}") for c in kept]
        return pa.RecordBatch.from_arrays([*columns, _vectors(o[at], np.ones(len(at), bool))], [*kept, out])

    def run(batches):
        now, found, rows = None, None, []
        for unit, part in _units(batches, units):
            if unit != now:
                if rows:
                    yield result(found, rows)
                now, found, rows = unit, _Merged(), []
            values = np.concatenate([_matrix(part.column("mixed")), part.column("total").to_numpy()[:, None]], 1)
            found.add(_places(part), part.column("head").to_numpy(), part.column("top").to_numpy(), values)
            own = part.filter(part.column("_own"))
            if own.num_rows:
                rows.append(own)
        if rows:
            yield result(found, rows)

    return run


def mix_tiles_kernel(config, key: str, units: list[str], weight: str, out: str, block: int):
    """mapInArrow function over weights as scores_kernel leaves their rows, with the values beside them."""

    def mixed(part, places, v):
        sizes = part.column(weight).value_lengths().to_numpy(zero_copy_only=False)
        theirs = np.all(part.column("kblock").to_numpy() == places[0] // block)
        if not theirs or not np.array_equal(np.searchsorted(places, _places(part), "right"), sizes):
            raise ValueError("a weighted position has no value")
        # Of equal places the last weight and the first value count, as in mix_kernel.
        at = np.searchsorted(places, places)
        w = np.zeros((part.num_rows, len(places)))
        row = np.repeat(np.arange(part.num_rows), sizes)
        column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        w[row, at[column]] = part.column(weight).flatten().to_numpy(zero_copy_only=False)
        own = part.column("head").to_numpy() // config.gqa_group
        o = np.zeros((part.num_rows, config.head_dim))
        for h in range(config.n_kv_heads):
            o[own == h] = w[own == h] @ v[:, h]
        return o

    def result(now, found, types):
        pos, head, _, o = found.merged()
        return _heads_of(key, now[0], (pos, head, o), out, *types)

    def run(batches):
        now, found, types, places, v = None, None, None, None, None
        for unit, part in _units(batches, units):
            if unit != now:
                if found:
                    yield result(now, found, types)
                now, found, types, places = unit, _Merged(), (part.column(key).type, part.column("pos").type), None
            starts = np.flatnonzero(np.asarray(part.column("_places").is_valid())).tolist()
            for a, b in zip([0, *starts], [*starts, part.num_rows]):
                if a == b:
                    continue
                if part.column("_places")[a].is_valid:
                    places = part.column("_places")[a].values.to_numpy(zero_copy_only=False)
                    v = part.column("_values")[a].values.to_numpy(zero_copy_only=False).reshape(len(places), config.n_kv_heads, config.head_dim)
                if places is None:
                    raise ValueError("a weighted position has no value")
                run_ = part.slice(a, b - a)
                found.add(_places(run_), run_.column("head").to_numpy(), np.zeros(b - a), mixed(run_, places, v))
        if found:
            yield result(now, found, types)

    return run


def mix_kernel(config, key: str, units: list[str], weight: str, out: str):
    """mapInArrow function over blocks of values and rows of weights for them: each row's weighted sum."""

    def run(batches):
        for values, rows in _pairs(batches, units):
            v = _matrix(values.column("v")).reshape(values.num_rows, config.n_kv_heads, config.head_dim)
            sizes = rows.column("kpos").value_lengths().to_numpy(zero_copy_only=False)
            kpos = rows.column("kpos").flatten().to_numpy(zero_copy_only=False)
            places = _places(values)
            at = np.searchsorted(places, kpos)
            if np.any(at == len(places)) or np.any(places[np.minimum(at, len(places) - 1)] != kpos):
                raise ValueError("a weighted position has no value")
            w = np.zeros((rows.num_rows, values.num_rows))
            w[np.repeat(np.arange(rows.num_rows), sizes), at] = rows.column(weight).flatten().to_numpy(zero_copy_only=False)
            own = rows.column("head").to_numpy(zero_copy_only=False) // config.gqa_group
            mixed = np.zeros((rows.num_rows, config.head_dim))
            for h in range(config.n_kv_heads):
                mixed[own == h] = w[own == h] @ v[:, h]
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), rows.column("pos"), rows.column("head"), _vectors(mixed, np.ones(len(mixed), bool))], [key, "pos", "head", out]
            )

    return run


def shard_kernel(units: list[str], kept: list[str], out: str, input_major: bool):
    """mapInArrow function over a shard of a matrix, as rows (row, w), and the vectors x that meet it.

    Output-major rows give an output each, in order; input-major ones are added up as outer products.
    """

    def run(batches):
        now, matrix = None, None
        for shard, rows in _pairs(batches, units):
            if shard is not now:
                order = np.argsort(shard.column("row").to_numpy(zero_copy_only=False))
                matrix = _matrix(shard.column("w"))[order]
                now, matrix = shard, np.ascontiguousarray(matrix if input_major else matrix.T)
            x = rows.column("_x")
            valid = np.asarray(x.is_valid())
            if np.any(np.asarray(x.value_lengths())[valid] != len(matrix)):
                raise ValueError(f"the matrix takes vectors of length {len(matrix)}")
            y = _matrix(x) @ matrix if valid.any() else np.zeros((0, matrix.shape[1]))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), _vectors(y, valid)], [*kept, out])

    return run
