"""Language-model scoring by a small causal self-attention model over subword ids, in numpy.

Statistics cover all training documents: word counts (for the unigram base) and subword counts (for the
classes and the distribution within a class) are aggregated in Spark. The attention weights are trained
by stochastic gradient descent on all windows of all training text, once, at every size: a hash deals the
documents to ``ROUNDS`` rounds and, in each, to replicas of about ``REPLICA_IDS`` ids, which train in tasks
of their own and are averaged by their steps after the round. Which replica a document is in and in which order
it comes depend on the documents alone, not on the cluster. A replica holds the windows of ``MIXED`` documents
at a time; a corpus of few windows is gone through again until a replica has made ``MIN_STEPS`` steps.

A text is its subword ids and an end id. Windows of ``WINDOW`` ids overlap by ``OVERLAP``; a batch of
windows goes through masked attention at once, and each id is scored once, in the window where it has at
least ``OVERLAP`` ids before it (or all there are). The probability of an id is that of its group of classes
and of its class in the group, both from the attention state, times its share of the class.

Edge cases: a null text is an empty one, whose only token is the end. A document without an id counts as
training text. Repeated rows are scored alike. Without training documents N and V
are 0 and the base is log10(1) = 0 a token; the model is then uniform over classes and ids. Extra columns are
never read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.text import col, forget_words, runs, word_ids
from motifline.session import discard, materialize

WINDOW, OVERLAP, WIDTH, ROWS = 32, 8, 16, 2048
#: GROUPS groups of GROUPS classes; the most frequent ids have a class each, the others share the last ones.
GROUPS = 32
CLASSES, OWN = GROUPS * GROUPS, GROUPS * (GROUPS - 1)
STEP = WINDOW - OVERLAP
#: Words whose counts every task has; the counts of the others come by a join.
FREQUENT = 200_000
#: Entries of a generation of a worker's subword cache.
CACHED = 250_000
#: Subword ids of a replica in a round, rounds, windows of a step and steps of a replica at least.
REPLICA_IDS, ROUNDS, BATCH, MIN_STEPS = 4_000_000, 2, 96, 200
#: Replicas that are averaged at once: more are averaged in groups first.
AVERAGED = 64
#: Documents whose windows are mixed before training.
MIXED = 256
TRAINED = ("E", "Q", "K", "V", "U", "R", "O", "b", "O2", "b2")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id as text leaves 1 modulo 5."""
    return F.pmod(F.crc32(F.coalesce(col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


class Vocabulary:
    """Rows (of the inputs), classes and shares (of the outputs) by subword id, from corpus counts."""

    def __init__(self, counts: np.ndarray, end: int):
        order = np.argsort(-counts, kind="stable")
        self.end, size = end, len(counts)
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        self.row = np.where(rank < ROWS, rank, ROWS + rank % 64).astype(np.int32)
        weight = counts + 0.5
        mass = np.cumsum(weight[order][OWN:])
        shared = OWN + np.minimum((mass / mass[-1] * (CLASSES - OWN)).astype(np.int64), CLASSES - OWN - 1)
        cls = np.empty(size, np.int64)
        cls[order] = np.concatenate([np.arange(OWN), shared])
        total = np.bincount(cls, weight, CLASSES)
        self.group, self.member = (cls % GROUPS).astype(np.int64), (cls // GROUPS).astype(np.int64)
        self.share = np.log(weight / np.maximum(total, 1e-300)[cls])
        mass = total.reshape(GROUPS, GROUPS).T + 1e-6  # by group, then class
        self.prior = np.log(mass.sum(1) / mass.sum()), np.log(mass / mass.sum(1, keepdims=True))

    def start(self) -> dict[str, np.ndarray]:
        """Weights before training: the class distribution of the corpus whatever the context."""
        g = np.random.default_rng(7)
        w = {"E": g.normal(0, 0.3, (ROWS + 64, WIDTH))}
        w |= {k: g.normal(0, WIDTH**-0.5, (WIDTH, WIDTH)) for k in "QKVU"}
        w |= {"R": np.zeros(WINDOW), "O": g.normal(0, 0.05, (WIDTH, GROUPS)), "O2": g.normal(0, 0.05, (GROUPS, WIDTH, GROUPS))}
        w |= {"b": self.prior[0], "b2": self.prior[1]}
        return {k: v.astype(np.float32) for k, v in w.items()}


_FAR = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None]
_MASK = np.where(_FAR < 0, -1e9, 0).astype(np.float32)
_FAR = np.maximum(_FAR, 0)


def attention(w: dict, rows: np.ndarray, first: np.ndarray | None = None):
    """Causal attention over a batch of windows: state of each position, and what backward() needs.

    The first OVERLAP places have a state only in the windows ``first`` (all, if None); in others they are only attended to.
    Those states come from further windows, whose last OVERLAP places they are and which have nothing before.
    """
    n, first = len(rows), np.arange(len(rows)) if first is None else first
    wide = np.empty((n + len(first), WINDOW), np.intp)
    wide[:n], wide[n:, :STEP], wide[n:, STEP:] = rows, 0, rows[first, :OVERLAP]
    x = np.take(w["E"], wide, axis=0)
    own = np.ascontiguousarray(x[:, OVERLAP:])  # the places that have a state
    k, v = (x.reshape(-1, WIDTH) @ np.array([w["K"], w["V"]])).reshape(2, *x.shape)
    q, u = (own.reshape(-1, WIDTH) @ np.array([w["Q"] * x.dtype.type(WIDTH**-0.5), w["U"]])).reshape(2, *own.shape)
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    a += (w["R"][_FAR] + _MASK).astype(x.dtype)[OVERLAP:]
    np.exp(a, out=a)
    a[n:, STEP - OVERLAP :, :STEP] = 0
    inverse = 1 / (a.reshape(-1, WINDOW) @ np.ones(WINDOW, a.dtype)).reshape(*own.shape[:-1], 1)
    c = a @ v
    c *= inverse
    u += c
    state = np.zeros((n, WINDOW, WIDTH), x.dtype)
    state[:, OVERLAP:] = u[:n]
    state[first, :OVERLAP] = u[n:, STEP - OVERLAP :]
    return state, (wide, first, x, own, q, k, v, a, c, inverse)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def _lowered(z: np.ndarray) -> None:
    """Less its rows' maxima, in place, if float32 might not hold sums of its exponentials."""
    if z.size and (z.max() > 60 or z.min() < -60):
        z -= z.max(-1, keepdims=True)


def _cross_entropy(z: np.ndarray, target: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Summed loss over rows divided by ``n``, and the gradient of z (in its place)."""
    at = np.arange(len(z)) * z.shape[1] + target
    _lowered(z)
    own = np.take(z, at)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    loss = (np.log(total) - own).sum() / n
    z *= (1 / (n * total))[:, None]
    z.ravel()[at] -= 1 / n
    return loss, z


#: Rows of a product with GROUPS columns for which BLAS still takes its kernels for small matrices.
BLOCK = 1536


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b for an ``a`` of many rows, by blocks of them."""
    out = np.empty((len(a), b.shape[1]), a.dtype)
    for i in range(0, len(a), BLOCK):
        np.matmul(a[i : i + BLOCK], b, out=out[i : i + BLOCK])
    return out


def _outputs(w: dict, state: np.ndarray, group: np.ndarray, member: np.ndarray) -> tuple[float, np.ndarray, dict]:
    """Loss and gradients of the states, a row each and in the order of their groups, and of the weights after them."""
    n = max(1, len(state))
    h = np.ones((len(state), WIDTH + 1), state.dtype)  # the last column takes the biases
    h[:, :WIDTH] = state
    top, low = np.concatenate([w["O"], w["b"][None]]), np.concatenate([w["O2"], w["b2"][:, None]], axis=1)
    loss, dz = _cross_entropy(_product(h, top), group, n)
    dstate, dtop = _product(dz, np.ascontiguousarray(w["O"].T)), np.zeros_like(top)
    for i in range(0, len(h), BLOCK):
        dtop += h[i : i + BLOCK].T @ dz[i : i + BLOCK]
    del dz
    cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    used = [(i, slice(lo, hi)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]  # each group one product
    z = np.empty((len(h), GROUPS), h.dtype)
    for i, at in used:
        np.matmul(h[at], low[i], out=z[at])
    more, z = _cross_entropy(z, member, n)
    dlow, back, part = np.zeros_like(low), np.ascontiguousarray(w["O2"].transpose(0, 2, 1)), np.empty_like(dstate)
    for i, at in used:
        np.matmul(h[at].T, z[at], out=dlow[i])
        np.matmul(z[at], back[i], out=part[at])
    dstate += part
    return loss + more, dstate, {"O": dtop[:WIDTH], "b": dtop[WIDTH], "O2": dlow[:, :WIDTH], "b2": dlow[:, WIDTH]}


def backward(w: dict, rows: np.ndarray, state, saved, target, valid: np.ndarray):
    """Loss and gradients for the (group, member) ``target`` at ``valid`` positions."""
    wide, first, x, own, q, k, v, a, c, inverse = saved
    flat = lambda t: t.reshape(-1, t.shape[-1])
    pick = np.flatnonzero(valid)
    group = np.take(target[0], pick)
    order = np.argsort(group.astype(np.int16), kind="stable")
    pick, group = pick[order], group[order]
    loss, dpick, g = _outputs(w, np.take(flat(state), pick, axis=0), group, np.take(target[1], pick))
    dh = np.zeros_like(state)
    flat(dh)[pick] = dpick
    both = np.zeros((2, *own.shape), state.dtype)  # gradients of q and u
    du = both[1]
    du[: len(dh)] = dh[:, OVERLAP:]
    du[len(dh) :, STEP - OVERLAP :] = dh[first, :OVERLAP]
    d = np.empty((*own.shape[:-1], WIDTH + 1), state.dtype)  # the last column is taken from each score: rows of a sum to 1 / inverse
    np.multiply(du, inverse, out=d[..., :WIDTH])
    np.einsum("bij,bij->bi", d[..., :WIDTH], -c, out=d[..., WIDTH])
    turned = np.ones((len(wide), WIDTH + 1, WINDOW), state.dtype)
    turned[:, :WIDTH] = v.transpose(0, 2, 1)
    ds = d @ turned
    ds *= a
    g["R"] = np.bincount(_FAR[OVERLAP:].ravel(), np.ones(len(ds), ds.dtype) @ ds.reshape(len(ds), -1), WINDOW)
    np.matmul(ds, k, out=both[0])
    pair = np.empty((2, *x.shape), state.dtype)  # gradients of k and v
    np.matmul(ds.transpose(0, 2, 1), q, out=pair[0])
    np.matmul(a.transpose(0, 2, 1), d[..., :WIDTH], out=pair[1])
    both, pair = both.reshape(2, -1, WIDTH), pair.reshape(2, -1, WIDTH)
    g |= zip("QU", flat(own).T @ both)
    g |= zip("KV", flat(x).T @ pair)
    g["Q"] *= WIDTH**-0.5
    dx = pair[0] @ np.ascontiguousarray(w["K"].T)
    dx += pair[1] @ np.ascontiguousarray(w["V"].T)
    dx = dx.reshape(x.shape)
    down = both[0] @ (w["Q"].T * dx.dtype.type(WIDTH**-0.5)).copy(order="C")
    down += both[1] @ np.ascontiguousarray(w["U"].T)
    dx[:, OVERLAP:] += down.reshape(own.shape)
    twos = np.result_type(dx, np.complex64)  # two numbers are added at a time
    at = (wide.reshape(-1, 1) * (WIDTH // 2) + np.arange(WIDTH // 2)).ravel()
    by_row = np.zeros(w["E"].size // 2, twos)
    np.add.at(by_row, at, dx.ravel().view(twos))
    g["E"] = by_row.view(dx.dtype).reshape(w["E"].shape)
    return loss, g


def train(w: dict, batches, rate: float = 0.02) -> tuple[dict, int]:
    """Adam over (rows, target, valid) batches."""
    flat = np.concatenate([w[k].ravel() for k in TRAINED])  # all weights in one row, so that a step is few operations
    cuts = np.cumsum([w[k].size for k in TRAINED])[:-1]
    w = {k: x.reshape(w[k].shape) for k, x in zip(TRAINED, np.split(flat, cuts))}
    slope, d, m, s = (np.zeros_like(flat) for _ in range(4))  # m and s: sums, 10 and 100 times Adam's means
    t = 0
    for rows, target, valid in batches:
        t += 1
        state, saved = attention(w, rows, np.flatnonzero(valid[:, :OVERLAP].any(1)))
        _, g = backward(w, rows, state, saved, target, valid)
        np.concatenate([g[k].ravel() for k in TRAINED], out=slope, casting="same_kind")
        lr = rate * min(1, t / 20) / (1 + t / 400) ** 0.5
        m *= 0.9
        m += slope
        slope *= slope
        s *= 0.99
        s += slope
        np.sqrt(s, out=d)
        root = (0.01 / (1 - 0.99**t)) ** 0.5
        d += 1e-8 / root
        np.divide(m, d, out=d)
        d *= 0.1 * lr / ((1 - 0.9**t) * root)
        flat -= d
    return w, t


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many tokens (end included): the text and the first token of every window."""
    per = 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP))
    text = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return text, nth * STEP


def score_texts(w: dict, vocab: Vocabulary, ids: list[np.ndarray], chunk: int = 256) -> np.ndarray:
    """Natural log probability of each text; ``ids`` without the end."""
    lengths = np.array([len(x) + 1 for x in ids], np.int64)
    if not len(lengths):
        return np.zeros(0)
    end = np.array([vocab.end], np.uint32)
    flat = np.concatenate([y for x in ids for y in (x, end)]).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    text, start = windows(lengths)
    rows, group, member, share = vocab.row[flat], vocab.group[flat], vocab.member[flat], vocab.share[flat]
    out = np.bincount(np.repeat(np.arange(len(lengths)), lengths), share, len(lengths))
    place, ones = np.arange(WINDOW), np.ones(WINDOW + GROUPS, np.float32)
    tab = {k: np.ascontiguousarray(w["E"] @ w[k]) for k in "QKVU"}
    tab["Q"] *= WIDTH**-0.5
    bias = (w["R"][_FAR] + _MASK).astype(np.float32)
    top, low = np.concatenate([w["O"], w["b"][None]]), np.concatenate([w["O2"], w["b2"][:, None]], axis=1)
    begin = vocab.row[vocab.end]
    parts = [(skip, of[i : i + chunk]) for skip, of in ((0, np.flatnonzero(start == 0)), (OVERLAP, np.flatnonzero(start))) for i in range(0, len(of), chunk)]
    for skip, part in parts:  # the first places of later windows, scored in the window before, are only attended to
        t, s = text[part], start[part]
        at = s[:, None] + place  # the token to predict
        scored = at[:, skip:] < lengths[t][:, None]
        at = np.minimum(at, lengths[t][:, None] - 1) + first[t][:, None]
        x = np.take(rows, at - 1, mode="wrap")
        if not skip:
            x[:, 0] = begin
        at, own = at[:, skip:], x[:, skip:]
        a = np.take(tab["Q"], own, axis=0) @ np.ascontiguousarray(np.take(tab["K"], x, axis=0).transpose(0, 2, 1))
        a += bias[skip:]
        np.exp(a, out=a)
        h = a @ np.take(tab["V"], x, axis=0)
        h /= (a.reshape(-1, WINDOW) @ ones[:WINDOW]).reshape(*own.shape, 1)
        h += np.take(tab["U"], own, axis=0)
        pick = np.flatnonzero(scored.ravel())
        goal = np.take(at.ravel(), pick)
        which = np.take(group, goal)
        order = np.argsort(which.astype(np.int16), kind="stable")  # by group, each then one product
        pick, goal, which = pick[order], goal[order], which[order]
        some = np.ones((len(pick), WIDTH + 1), np.float32)  # the last column takes the biases
        some[:, :WIDTH] = np.take(h.reshape(-1, WIDTH), pick, axis=0)
        z = _product(some, top)
        _lowered(z)
        at = np.arange(len(z)) * GROUPS
        got = np.take(z, at + which).astype(np.float64)
        np.exp(z, out=z)
        got -= np.log(z @ ones[:GROUPS])
        cuts = np.searchsorted(which, np.arange(GROUPS + 1))
        for k, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if hi > lo:
                np.matmul(some[lo:hi], low[k], out=z[lo:hi])
        _lowered(z)
        got += np.take(z, at + np.take(member, goal))
        np.exp(z, out=z)
        got -= np.log(z @ ones[:GROUPS])
        out += np.bincount(np.repeat(t, WINDOW - skip)[pick], got, len(lengths))
    return out


def _chunks(batches, size: int):
    """The rows of several batches in one, each of about ``size`` bytes."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.nbytes
        if n >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def split_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words one after the other, lower-cased (A-Z)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, cuts = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    cuts -= cuts[0]
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty one
    if len(words) and not pc.all(some).as_py():
        cuts = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[cuts]
        words = words.filter(some)
    return np.diff(cuts), words


def _counted(chunk: int = 16 << 20):
    """Word counts of a task, by chunks of text; the empty word stands for the ends."""

    def run(batches):
        docs = 0
        for b in _chunks(batches, chunk):
            docs += b.num_rows
            found = pc.value_counts(split_words(b.column(0))[1])
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "c"])
        if docs:  # the end of each text
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([docs], pa.int64())], ["word", "c"])

    return run


def _encoded(tokenizer: str, kind: str, log: dict[bytes, float], chunk: int = 8 << 20):
    """Ids of each text in the numpy type ``kind``, and its base score but for the words that have no ``log``.

    What is looked up by word in Python is looked up once for each distinct word of a chunk.
    """

    def run(batches):
        cache, part, nth = word_ids(tokenizer, CACHED), TaskContext.get().partitionId(), 0
        for b in _chunks(batches, chunk):
            n, words = split_words(b.column(2))
            cuts = np.concatenate([[0], np.cumsum(n)])
            words = words.dictionary_encode()
            at, words = words.indices.to_numpy(), words.dictionary.cast(pa.binary())
            distinct = words.to_pylist()
            worth = np.array([log.get(w, np.nan) for w in distinct], float)
            got = cache.of_each(distinct)
            size = np.dtype(kind).itemsize
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4 * size)])
            got = pa.py_buffer(np.frombuffer(b"".join(got), np.uint32).astype(kind))
            got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(ends), got]).take(pa.array(at))
            ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset :][: len(got) + 1]
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends[cuts]), got.buffers()[2]]).cast(pa.binary())
            worth = worth[at]
            missing = np.isnan(worth)
            worth[missing] = 0
            text = np.repeat(np.arange(len(n)), n)
            rare = np.bincount(text[missing], minlength=len(n))
            base = np.bincount(text, worth, len(n))
            rare_cuts = pa.array(np.concatenate([[0], np.cumsum(rare)]), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([part] * len(n), pa.int32()),
                    pa.array(range(nth, nth + len(n)), pa.int64()),
                    pa.array(n + 1, pa.int64()),
                    pa.array(n - rare, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.ListArray.from_arrays(rare_cuts, words.take(pa.array(at[missing]))),
                    ids,
                ],
                ["id", "held_out", "part", "nth", "n", "known", "base", "rare", "ids"],
            )
            for lo in range(0, len(n), 256):
                yield out.slice(lo, 256)
            nth += len(n)

    return run


def _id_counts(kind: str, id_count: int):
    def run(batches):
        forget_words()
        c = np.zeros(id_count, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                joined = b"".join(b.column(0).slice(lo, 256).to_pylist())
                c += np.bincount(np.frombuffer(joined, kind), minlength=id_count)
        used = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(c[used], pa.int64())], ["id", "c"])

    return run


def _cut(texts_ids: list[bytes], kind: str, end: int, g: np.random.Generator | None = None) -> np.ndarray:
    """All windows of WINDOW + 1 ids, the one before the first included, from every STEPth id; -1 after a text's end. ``g`` mixes them."""
    size = np.array([len(x) for x in texts_ids], np.int64) // np.dtype(kind).itemsize + 1  # end included
    mark = np.array([end], kind).tobytes()
    flat = np.frombuffer(mark + b"".join([x + mark for x in texts_ids]), kind).astype(np.int32)  # an end is also the one before the next text
    first, per = np.cumsum(size) - size, -(-size // STEP)
    text = np.repeat(np.arange(len(size)), per)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)) * STEP
    if g is not None:
        order = g.permutation(len(text))
        text, start = text[order], start[order]
    out = np.take(flat, (first[text] + start)[:, None] + np.arange(WINDOW + 1), mode="clip")
    left = size[text] - start  # ids from the second one of the window on
    short = np.flatnonzero(left < WINDOW)
    out[short] = np.where(np.arange(WINDOW + 1) <= left[short, None], out[short], -1)
    return out


def _pack(w: dict) -> bytes:
    f = io.BytesIO()
    np.savez(f, **w)
    return f.getvalue()


def _replica(vocab: Vocabulary, weights: dict, kind: str, batch: int = BATCH, seed: int = 0):
    """Batches of ids -> one row of trained weights and how many steps they took."""

    def run(batches):
        def cut():
            g = np.random.default_rng(seed)
            for b in batches:
                for lo in range(0, b.num_rows, MIXED):
                    yield _cut(b.column(0).slice(lo, MIXED).to_pylist(), kind, vocab.end, g)

        def steps_of(ids):
            valid = ids[:, 1:] >= 0
            valid[ids[:, 0] != vocab.end, :OVERLAP] = False  # learnt in the window before, as in scoring
            ids = np.where(ids >= 0, ids, vocab.end)
            rows, group, member = np.take(vocab.row, ids[:, :-1]), np.take(vocab.group, ids[:, 1:]), np.take(vocab.member, ids[:, 1:])
            for i in range(0, len(ids), batch):
                at = slice(i, i + batch)
                yield rows[at], (group[at], member[at]), valid[at]

        def drawn():
            few, n = [], 0  # the first ones, kept while they may have to be repeated
            for ids in cut():
                few, n = [*few, ids] if n < MIN_STEPS * batch else [], n + len(ids)
                yield from steps_of(ids)
            if 0 < n < MIN_STEPS * batch:
                few, made = np.concatenate(few), -(-n // batch)
                for _ in range(-(-MIN_STEPS // made) - 1):
                    yield from steps_of(few)

        w, steps = train(weights, drawn())
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(w)], pa.binary()), pa.array([steps], pa.int64())], ["w", "steps"])

    return run


def _replicas(vocab: Vocabulary, weights: dict, kind: str):
    """Rows (ids, replica, place) by replica -> (replica, w, steps)."""

    def run(batches):
        forget_words()
        for t in runs(batches, ["replica"]):
            nth = t["replica"][0].as_py()
            for b in _replica(vocab, weights, kind, seed=nth)(iter(t.select(["ids"]).combine_chunks().to_batches())):
                yield pa.RecordBatch.from_arrays([pa.array([nth], pa.int64()), *b.columns], ["replica", "w", "steps"])

    return run


def _mean(packed: list[bytes], steps: list[int]) -> bytes:
    """Weights averaged by steps."""
    share = np.array(steps, float) / sum(steps)
    out: dict = {}
    for s, x in zip(share, packed):
        w = np.load(io.BytesIO(x))
        out = {k: out.get(k, 0) + s * w[k] for k in TRAINED}
    return _pack({k: v.astype(np.float32) for k, v in out.items()})


def _average(parts: DataFrame, n: int) -> dict[str, np.ndarray] | None:
    """The weights of ``n`` replicas (replica, w, steps) averaged, at most ``AVERAGED`` in one place; None without any."""

    def some(t: pa.Table) -> pa.Table:
        t = t.sort_by("replica")
        steps = t["steps"].to_pylist()
        mean = _mean(t["w"].to_pylist(), steps)
        return pa.table({"replica": pa.array([t["replica"][0].as_py() // AVERAGED], pa.int64()), "w": pa.array([mean], pa.binary()), "steps": pa.array([sum(steps)], pa.int64())})

    while n > AVERAGED:
        of = F.floor(F.col("replica") / AVERAGED)
        parts = materialize(parts.groupBy(of).applyInArrow(some, "replica bigint, w binary, steps bigint"), "weights")
        n = -(-n // AVERAGED)
    rows = sorted(parts.collect(), key=lambda r: r["replica"])  # AVERAGED at most
    if not rows:
        return None
    with np.load(io.BytesIO(_mean([r["w"] for r in rows], [r["steps"] for r in rows]))) as w:
        return {k: w[k] for k in TRAINED}


def count_words(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, int, int, int]:
    """(table of word and count, N, V, texts) of training documents; the empty word counts the ends."""
    counted = docs.select(col(text_col)).mapInArrow(_counted(), "word binary, c bigint")
    counts = materialize(counted.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    ends = F.sum(F.when(F.octet_length("word") == 0, F.col("c")))
    return counts, *counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(ends, F.lit(0))).first()


def _least_frequent(counts: DataFrame) -> int:
    """The least count that at most FREQUENT words reach, from the numbers of words by binary order of their count."""
    order = F.floor(F.log2("c") * 8).cast("int")
    least, words = 1 << 62, 0
    for r in sorted(counts.groupBy(order.alias("o")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r["o"]):  # 8 * 63 at most
        words += r["n"]
        if words > FREQUENT:
            break
        least = r["c"]
    return least


def fit(ids: DataFrame, kind: str, n_docs: int, end_id: int, id_count: int) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Classes and trained weights from the encoded training documents: id, and ids in the numpy type ``kind``."""
    by_id = np.zeros(id_count)
    for r in ids.select("ids").mapInArrow(_id_counts(kind, id_count), "id int, c bigint").groupBy("id").agg(F.sum("c").alias("c")).collect():
        by_id[r["id"]] = r["c"]  # as many rows as the tokenizer has ids
    total = int(by_id.sum()) + n_docs
    by_id[end_id] = n_docs
    vocab = Vocabulary(by_id, end_id)
    weights = vocab.start()
    replicas = -(-total // (ROUNDS * REPLICA_IDS))
    place = F.xxhash64("id", "ids")
    dealt = ids.select("ids", place.alias("place"), F.pmod(place, F.lit(ROUNDS)).alias("round"))
    dealt = dealt.withColumn("replica", F.pmod(F.shiftright("place", 8), F.lit(max(1, replicas))))
    for k in range(ROUNDS if replicas else 0):
        rows = dealt.where(F.col("round") == k).select("ids", "replica", "place")
        rows = rows.repartitionById(replicas, F.col("replica").cast("int")).sortWithinPartitions("replica", "place")
        parts = materialize(rows.mapInArrow(_replicas(vocab, weights, kind), "replica bigint, w binary, steps bigint"), "weights")
        weights = _average(parts, replicas) or weights
        discard(parts)
    return vocab, weights


def _scored(kind: str, vocab: Vocabulary, weights: dict):
    """The columns before the last one as they are, and the log10 probability of the ids in the last one."""

    def run(batches):
        forget_words()
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                ids = [np.frombuffer(x, kind) for x in b.columns[-1].to_pylist()]
                score = pa.array(score_texts(weights, vocab, ids) / np.log(10), pa.float64())
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], score], [*b.schema.names[:-1], "score"])

    return run


def score_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 49407, id_count: int = 49408
) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Every text is tokenized once: its ids, two bytes each, are a written table from which the classes, the
    training windows and the scores come.
    """
    src = docs.select(col(id_col).alias("id"), held_out(id_col).alias("held_out"), col(text_col).alias("text"))
    counts, total, distinct, n_docs = count_words(src.where("not held_out"))
    denominator = total + 0.5 * (distinct + 1)
    least = _least_frequent(counts)
    top = counts.where((F.octet_length("word") > 0) & (F.col("c") >= least)).collect()  # FREQUENT at most
    log = {bytes(r["word"]): float(np.log10((r["c"] + 0.5) / denominator)) for r in top}
    plain = f"id {src.schema['id'].dataType.simpleString()}, held_out boolean, part int, nth bigint, n bigint, known bigint, base double"
    kind = "<u2" if id_count <= 1 << 16 else "<u4"
    partial = materialize(src.mapInArrow(_encoded(tokenizer, kind, log), f"{plain}, rare array<binary>, ids binary"), "encoded")
    vocab, weights = fit(partial.where("not held_out").select("id", "ids"), kind, n_docs, end_id, id_count)
    scored = materialize(partial.drop("rare").mapInArrow(_scored(kind, vocab, weights), f"{plain}, score double"), "scored")
    rare = partial.where(F.size("rare") > 0).select("part", "nth", F.explode("rare").alias("word"))
    others = counts.where(F.col("c") < least)
    value = F.coalesce("c", F.lit(0))
    sums = (
        rare.join(others, "word", "left")
        .groupBy("part", "nth")
        .agg(F.count("c").alias("more"), F.sum(F.log10((value + 0.5) / denominator)).alias("worth"))
    )
    ends = counts.where("octet_length(word) = 0").select("c").first()
    ends = ends["c"] if ends else 0
    end_worth = float(np.log10((ends + 0.5) / denominator))
    out = scored.join(sums, ["part", "nth"], "left")
    return out.select(
        "id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("worth", F.lit(0.0)) + F.lit(end_worth)).alias("base_score"),
        "score",
    )
