"""Language-model scoring: a causal self-attention model in numpy on subword ids, and a word unigram base.

One pass over the texts makes blocks of documents, bounded by words: a block's
dictionary, the places of its words in its documents, the subword ids of each
word. Word counts of all training documents meet the blocks' dictionaries by
word; each block then scores its own documents.

The attention model gives the class of the next subword from those before it in
the document; a subword's share of its class, after subwords of the hashed kind of
the one before it, and the classes themselves come from the counts of all training
documents. The network's weights start from those counts;
then every block learns from every window of all its training documents, once, and the weights of
all blocks are averaged by the places they learned from. Scoring runs over windows of 2 * STRIDE positions that
overlap by STRIDE: a window scores its second half, so each subword is scored
once, with at least STRIDE positions before it, as far as its document has them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written
from .tokens import default_path, ids_of

STRIDE = 16
WIDTH = 16
CLASSES = 64
#: Hashed kinds of the subword before.
KINDS = 64
#: Places' worth of a class's own shares among those after a kind of subword.
PRIOR = 20.0
BLOCK_WORDS = 300_000
BLOCK_TOKENS = 4_000_000
#: Words of the documents that a block works on at a time, and subwords whose sums travel together.
RUN_WORDS = 150_000
CHUNK = 512
#: Rows of sums that a task adds up.
FAN_IN = 64
#: Stands for the end of a document; no word has a space.
_END = b" "


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _pack(**arrays) -> bytes:
    return pa.compress(pickle.dumps(arrays, protocol=5), codec="zstd", asbytes=True)


def _unpack(blob, size: int) -> dict:
    return pickle.loads(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True))


def subwords(words: list[bytes], path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all words, and how many each has; the end's is its own."""
    ends = [i for i, w in enumerate(words) if w == _END]
    ids, per = ids_of(path).words([w.decode("utf-8", "replace") for w in words if w != _END])
    if not ends:
        return ids, per
    before = [i - k for k, i in enumerate(ends)]  # words that stand before each end
    at = np.concatenate([[0], np.cumsum(per)])
    return np.insert(ids, at[before], end_id), np.insert(per, before, 1)


_BLOCK = "block long, word long, local int, n long, size long, blob binary"


def blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """From rows (doc_id, held_out, text): a row per block (blob), and a row for each word of its dictionary with its count in training documents."""
    names = ["block", "word", "local", "n", "size", "blob"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def block():
            flat = np.concatenate(tokens)
            lengths = np.array(list(map(len, tokens)))
            counted = np.bincount(flat[np.repeat(~np.array(held), lengths)], minlength=len(local))
            ids, per = subwords(list(local), path, end_id)
            data = pickle.dumps({"doc_id": doc_ids, "held": held, "flat": flat, "lengths": lengths, "ids": ids.astype(np.uint32), "per": per.astype(np.uint32), "counted": counted}, protocol=5)
            number = (part << 32) + made
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((number, None, None, None, len(data), pa.compress(data, codec="zstd", asbytes=True)), types, strict=True)], names)
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local)).view(np.int64)
            for at in range(0, len(words), 50_000):
                w = words[at : at + 50_000]
                none = [pa.nulls(len(w), t) for t in types[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), number)), pa.array(w), pa.array(np.arange(at, at + len(w), dtype=np.int32)), pa.array(counted[at : at + len(w)].astype(np.int64)), *none], names)

        local, tokens, doc_ids, held, total = _Local(), [], [], [], 0
        for b in batches:
            for doc_id, out, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(_END)
                tokens.append(np.fromiter(map(local.__getitem__, words), np.uint32, len(words)))
                doc_ids.append(doc_id)
                held.append(out)
                total += len(words)
                if len(local) > BLOCK_WORDS or total > BLOCK_TOKENS:
                    yield from block()
                    local, tokens, doc_ids, held, total = _Local(), [], [], [], 0
                    made += 1
        if tokens:
            yield from block()

    return docs.mapInArrow(run, _BLOCK)


_GAP = np.arange(2 * STRIDE)[:, None] - np.arange(2 * STRIDE)[None]


def gradients(p: dict, X: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the summed loss over the targets ``y`` of windows, by weight, and by the rows of X; a target below 0 doesn't count. ``own`` is where each position's document starts, from its window's start."""
    flat = lambda z: z.reshape(-1, z.shape[-1])
    W = np.concatenate([p["Q"] / 4, p["K"], p["V"]], 1)
    Q, K, V = np.split((flat(X) @ W).reshape(*X.shape[:2], -1), 3, -1)
    A = Q @ K.transpose(0, 2, 1)
    A += np.where(_GAP >= 0, p["near"][np.maximum(_GAP, 0)], np.float32(-1e9))
    crossing = own.max(1) > 0  # elsewhere a window has one document alone
    if crossing.any():
        A[crossing] = np.where(np.arange(2 * STRIDE)[None, None] >= own[crossing][:, :, None], A[crossing], np.float32(-1e9))
    A -= np.einsum("btt->bt", A)[:, :, None].copy()  # a position sees itself, so no sum is below 1
    np.exp(np.minimum(A, 60, out=A), out=A)
    A *= 1 / (A @ np.ones((2 * STRIDE, 1), np.float32))
    O = A @ V
    H = flat(X + O)
    P = H @ p["C"]
    P += p["c"]
    # the end id as a target belongs to its document; what follows it does not, but costs nothing to learn
    y = y.ravel()
    at = np.arange(y.size), np.maximum(y, 0)
    P -= P[at][:, None]
    np.exp(np.minimum(P, 60, out=P), out=P)
    P *= 1 / (P @ np.ones((CLASSES, 1), np.float32))
    P[at] -= 1
    if (y < 0).any():
        P[y < 0] = 0
    dH = (P @ p["C"].T).reshape(X.shape)
    dS = dH @ V.transpose(0, 2, 1)
    dS -= np.einsum("btw,btw->bt", dH, O)[:, :, None]
    dS *= A
    D = flat(np.concatenate([dS @ K, dS.transpose(0, 2, 1) @ Q, A.transpose(0, 2, 1) @ dH], -1))
    dX = flat(dH) + D @ W.T
    dQ, dK, dV = np.split(flat(X).T @ D, 3, 1)
    near = np.bincount(np.maximum(_GAP, 0).ravel(), np.where(_GAP >= 0, dS.sum(0), 0).ravel(), 2 * STRIDE).astype(np.float32)
    return {"Q": dQ / 4, "K": dK, "V": dV, "near": near, "C": H.T @ P, "c": np.ones(len(P), np.float32) @ P}, dX


class Attention:
    """One layer of causal self-attention over subword embeddings, with a bias by distance; predicts the class of the next subword."""

    def __init__(self, classes: np.ndarray, end_id: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = len(classes)
        self.classes, self.end_id = classes, end_id
        small = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.p = {"E": small(n, WIDTH), "Q": small(WIDTH, WIDTH), "K": small(WIDTH, WIDTH), "V": small(WIDTH, WIDTH), "near": np.zeros(2 * STRIDE, np.float32), "C": small(WIDTH, CLASSES), "c": np.zeros(CLASSES, np.float32)}

    def start(self, left: np.ndarray) -> None:
        """Weights from the counts of all training documents: classes by the kind of the subword before, as a product of WIDTH dimensions."""
        after = np.stack([np.bincount(self.classes, c, CLASSES) for c in left.T]) + 1e-9
        c = np.log((after.sum(0) + 0.5) / (after.sum() + 0.5 * CLASSES))
        told = (after + PRIOR * np.exp(c)) / (after.sum(1, keepdims=True) + PRIOR)
        u, s, v = np.linalg.svd(np.log(told) - c)
        s = np.sqrt(s[:WIDTH])
        self.p["E"] = (0.25 * self.p["E"] + (u[:, :WIDTH] * s)[kind_of(np.arange(len(self.classes)))]).astype(np.float32)
        self.p["C"], self.p["c"] = (s[:, None] * v[:WIDTH]).astype(np.float32), c.astype(np.float32)

    def learn(self, runs, batch: int = 128, rate: float = 0.15, seed: int = 11) -> tuple[dict, np.ndarray]:
        """Adagrad steps over every window of each of ``runs`` of documents (ids, opens), in random order; returns how the weights changed, and the places of each subword seen as input."""
        rng, T = np.random.default_rng(seed), 2 * STRIDE
        p, n = {k: x.copy() for k, x in self.p.items()}, len(self.classes)
        power, places = {k: np.zeros_like(x) for k, x in p.items()}, np.zeros(n, np.int64)
        small = np.uint16 if n <= 1 << 16 else np.int64  # sorts faster
        for ids, opens in runs:
            order = rng.permutation(-(-len(ids) // T))
            before = np.concatenate([[self.end_id], ids[:-1]])
            before[opens] = self.end_id  # an end id opens each document
            begin = np.repeat(opens, np.diff(np.append(opens, len(ids))))
            places += np.bincount(before, minlength=n)
            target = self.classes[ids]
            for lo in range(0, len(order), batch):
                at = order[lo : lo + batch, None] * T + np.arange(T)[None]
                own = np.minimum(at, len(ids) - 1)
                x, y = before[own], np.where(at == own, target[own], -1)
                own = begin[own] - at[:, :1]  # where a position's document starts, from its window's start
                g, dX = gradients(p, p["E"][x], y, own)
                scale = np.float32(1 / max(1, (y >= 0).sum()))
                flat = x.ravel().astype(small)
                by = np.argsort(flat, kind="stable")
                rows = flat[by]
                heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                rows = rows[heads].astype(np.int64)
                dE = np.add.reduceat(dX[by], heads) * scale
                power["E"][rows] += dE**2
                p["E"][rows] -= rate * dE / (np.sqrt(power["E"][rows]) + 1e-8)
                for k, d in g.items():
                    d = d * scale
                    power[k] += d**2
                    p[k] -= rate * d / (np.sqrt(power[k]) + 1e-8)
        return {k: p[k] - self.p[k] for k in p}, places

    def tables(self) -> dict:
        """Queries, keys and values of every subword: with one layer they depend on the id alone."""
        p = self.p
        return {"E": p["E"], "Q": p["E"] @ p["Q"] / 4, "K": p["E"] @ p["K"], "V": p["E"] @ p["V"], "near": p["near"], "C": p["C"], "c": p["c"], "classes": self.classes, "end_id": self.end_id}


def log_likelihood(t: dict, ids: np.ndarray, first: np.ndarray, share: np.ndarray, windows: int = 128) -> np.ndarray:
    """Natural log probability of each id of a flat array of documents, ``first`` giving the start of each position's document.

    Position i sees the end id in the place of its document's start, then the ids before it. ``share`` is that of :func:`shares`.
    """
    n = len(ids)
    padded = -(-max(n, 1) // STRIDE) * STRIDE
    x = np.full(padded + STRIDE, t["end_id"], np.int64)  # one stride of padding before
    x[STRIDE + 1 : STRIDE + n] = ids[:-1]
    x[STRIDE + np.unique(first)] = t["end_id"]
    starts = np.full(padded, n, np.int64)
    starts[:n] = first
    out = np.empty(padded, np.float32)
    gap = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None]
    bias = np.where(gap >= 0, t["near"][np.clip(gap, 0, 2 * STRIDE - 1)], -np.inf).astype(np.float32)
    target = np.zeros(padded, np.int64)
    target[:n] = t["classes"][ids]
    for w in range(0, padded // STRIDE, windows):
        k = min(windows, padded // STRIDE - w)
        at = x[w * STRIDE : (w + k + 1) * STRIDE]
        own = at[STRIDE:]
        K, V = (np.concatenate([c[:-1], c[1:]], 1) for c in (t[z][at].reshape(k + 1, STRIDE, WIDTH) for z in "KV"))
        S = t["Q"][own].reshape(k, STRIDE, WIDTH) @ K.transpose(0, 2, 1)
        S += bias
        begin = starts[w * STRIDE : (w + k) * STRIDE].reshape(k, STRIDE) - (np.arange(w - 1, w + k - 1) * STRIDE)[:, None]
        crossing = begin.max(1) > 0  # elsewhere a window has no other document before its own
        if crossing.any():
            S[crossing] = np.where(np.arange(2 * STRIDE)[None, None] >= np.minimum(begin[crossing], np.arange(STRIDE) + STRIDE)[:, :, None], S[crossing], -np.inf)
        np.exp(np.minimum(S, 60, out=S), out=S)
        H = t["E"][own] + ((S @ V) / (S @ np.ones((2 * STRIDE, 1), np.float32))).reshape(-1, WIDTH)
        L = H @ t["C"]
        L += t["c"]
        picked = L[np.arange(len(L)), target[w * STRIDE : (w + k) * STRIDE]]
        np.exp(np.minimum(L, 60, out=L), out=L)
        out[w * STRIDE : (w + k) * STRIDE] = np.minimum(picked, 60) - np.log(L @ np.ones(CLASSES, np.float32))
    return out[:n].astype(np.float64) + share[ids, kind_of(x[STRIDE : STRIDE + n])]


def kind_of(ids: np.ndarray) -> np.ndarray:
    return (ids * 2654435761 >> 7) % KINDS


def left_neighbours(ids: np.ndarray, opens: np.ndarray, end_id: int) -> np.ndarray:
    """How often each subword follows one of the hashed kinds of subwords, flat; the end id stands before a document."""
    before = np.concatenate([[end_id], ids[:-1]])
    before[opens] = end_id
    return np.bincount(ids * KINDS + kind_of(before), minlength=KINDS * (end_id + 1))


def shares(left: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log of each subword's share of its class, by the kind of the subword before: counted, with PRIOR places of its share after any."""
    own = left.sum(1) + 0.5
    own /= np.bincount(classes, own, CLASSES)[classes]
    total = np.stack([np.bincount(classes, c, CLASSES) for c in left.T], 1)
    return np.log((left + PRIOR * own[:, None]) / (total[classes] + PRIOR)).astype(np.float32)


def class_of_subwords(left: np.ndarray, seed: int = 5) -> np.ndarray:
    """Classes by what stands before a subword in all training documents: k-means on kinds of left neighbours; ids that none has are dealt out."""
    rng = np.random.default_rng(seed)
    counts = left.sum(1)
    classes = np.arange(len(left)) % CLASSES
    seen = np.flatnonzero(counts)
    if len(seen) <= CLASSES:
        classes[seen] = np.arange(len(seen))
        return classes
    z = np.sqrt(left[seen] / counts[seen, None]).astype(np.float32)
    centers = z[rng.choice(len(seen), CLASSES, replace=False, p=counts[seen] / counts[seen].sum())]
    for _ in range(12):
        own = (z @ centers.T - 0.5 * (centers**2).sum(1)).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, z * counts[seen, None])
        total = np.bincount(own, counts[seen], CLASSES)
        centers = np.where(total[:, None] > 0, sums / np.maximum(total[:, None], 1), centers).astype(np.float32)
    classes[seen] = own
    return classes


def training_runs(d: dict, words: int = RUN_WORDS):
    """(ids, opens) of a block's training documents, in runs of about ``words`` words: subword ids, and where each document starts."""
    per, held = d["per"].astype(np.int64), np.array(d["held"], bool)
    at, begin = np.cumsum(per) - per, np.cumsum(d["lengths"]) - d["lengths"]
    docs = np.flatnonzero(~held)
    for lo, hi in _runs(d["lengths"][docs], words):
        of = [d["flat"][begin[i] : begin[i] + d["lengths"][i]] for i in docs[lo:hi]]
        w = np.concatenate(of)
        k = per[w]
        place = np.cumsum(k) - k
        ids = d["ids"][np.repeat(at[w] - place, k) + np.arange(k.sum())].astype(np.int64)
        yield ids, place[np.cumsum([0, *map(len, of[:-1])])]


def summed(blobs: DataFrame, shape: tuple[int, int], of_block) -> np.ndarray:
    """The sum over all blocks of the arrays ``of_block`` gives: each task adds up its own, rows meet in chunks, FAN_IN of them at a time, level by level."""
    kind = "chunk long, part long, sums binary"

    def row(chunk: int, part: int, sums: np.ndarray) -> dict:
        return {"chunk": pa.array([chunk], pa.int64()), "part": pa.array([part], pa.int64()), "sums": pa.array([pa.compress(sums.tobytes(), codec="zstd", asbytes=True)], pa.binary())}

    def read(chunk: int, sums) -> np.ndarray:
        size = 8 * shape[1] * min(CHUNK, shape[0] - chunk)
        return np.frombuffer(pa.decompress(sums, decompressed_size=size, codec="zstd", asbytes=True), np.float64)

    def partial(batches):
        total = None
        for b in batches:
            for size, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                got = of_block(_unpack(blob.as_buffer(), size))
                total = got if total is None else np.add(total, got, out=total)
        if total is not None:
            for c in range(0, shape[0], CHUNK):
                if (part := total[c : c + CHUNK]).any():
                    yield pa.RecordBatch.from_pydict(row(c, TaskContext.get().partitionId(), part))

    def whole(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk")[0].as_py()
        total = 0.0
        for _, x in sorted(zip(t.column("of").to_pylist(), t.column("sums").to_pylist(), strict=True)):
            total = total + read(chunk, x)
        return pa.table(row(chunk, t.column("part")[0].as_py(), total))

    found, parts = blobs.mapInArrow(partial, kind), blobs.rdd.getNumPartitions()
    while True:
        found = found.withColumnRenamed("part", "of").withColumn("part", F.floor(F.col("of") / FAN_IN))
        found = found.groupBy("chunk", "part").applyInArrow(whole, kind)
        if parts <= FAN_IN:
            break
        parts = -(-parts // FAN_IN)
    out = np.zeros(shape)
    for r in found.collect():  # as many rows as chunks
        out[r["chunk"] : r["chunk"] + CHUNK] = read(r["chunk"], bytes(r["sums"])).reshape(-1, shape[1])
    return out


def counted_left(blobs: DataFrame, end_id: int) -> np.ndarray:
    """Left neighbours of every subword in all training documents."""

    def of_block(d: dict) -> np.ndarray:
        out = np.zeros(KINDS * (end_id + 1))
        for ids, opens in training_runs(d, 4 * RUN_WORDS):
            out += left_neighbours(ids, opens, end_id)
        return out.reshape(-1, KINDS)

    return summed(blobs, (end_id + 1, KINDS), of_block)


def learned(blobs: DataFrame, net: Attention) -> Attention:
    """``net`` after every block learned from its training documents, from the same start.

    An embedding's changes are averaged by the subword's places in each block, all
    other weights' by the block's places.
    """
    start, size = blobs.sparkSession.sparkContext.broadcast(net), len(net.classes)
    rest = [k for k in net.p if k != "E"]
    n_rest = sum(net.p[k].size for k in rest)
    tail = -(-(n_rest + 1) // (WIDTH + 1))  # the other weights and their places fill rows below the embeddings

    def of_block(d: dict) -> np.ndarray:
        change, places = start.value.learn(training_runs(d))
        out = np.zeros((size + tail, WIDTH + 1))
        out[:size, :WIDTH], out[:size, WIDTH] = change["E"] * places[:, None], places
        out[size:].ravel()[: n_rest + 1] = np.append(np.concatenate([change[k].ravel() for k in rest]).astype(np.float64) * places.sum(), places.sum())
        return out

    total = summed(blobs, (size + tail, WIDTH + 1), of_block)
    out = Attention(net.classes, net.end_id)
    out.p["E"] = (net.p["E"] + total[:size, :WIDTH] / np.maximum(total[:size, WIDTH:], 1)).astype(np.float32)
    flat = total[size:].ravel()
    change = np.split(flat[:n_rest] / max(flat[n_rest], 1), np.cumsum([net.p[k].size for k in rest])[:-1])
    for k, x in zip(rest, change, strict=True):
        out.p[k] = (net.p[k] + x.reshape(net.p[k].shape)).astype(np.float32)
    return out


def score(docs: DataFrame, folds: int = 5, held_fold: int = 1, sample: int = 0, word_share: float = 0.5, tokenizer_path: str | None = None, end_id: int = 50256) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs`` (doc_id, text).

    Counts, classes and shares come from all documents whose crc32(doc_id) mod
    ``folds`` is not ``held_fold``, and so do the weights, from every window of them. ``sample`` is left for
    callers that still give it, and changes nothing: no model comes from a sample.
    ``score`` interpolates, word by word, the network's chance of the word's subwords in their context with the word's own of
    ``base_score``, which has ``word_share`` of the weight (0: the network alone). Null text is empty: one end token.
    Texts of any length are read whole; a block of documents holds one of them at least. Rows that share an id, or
    have none, are separate documents, scored by their own texts. Empty input gives an empty
    result. Without training documents every word is unknown.
    """
    spark, path = docs.sparkSession, tokenizer_path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    made = written(blocks(rows, path, end_id), "lm-blocks")
    words = made.filter("word IS NOT NULL").select("word", "block", "local", "n")
    counts = words.filter("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    blobs = made.filter("blob IS NOT NULL").select("block", "size", "blob")

    left = counted_left(blobs, end_id)
    net = Attention(class_of_subwords(left), end_id)
    net.start(left)
    net = learned(blobs, net)
    share = shares(left, net.classes)
    counts = written(counts, "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = spark.sparkContext.broadcast((net.tables(), share, n, v))
    known = words.join(counts, "word").select(F.col("block").alias("of_block"), "local", "c")
    n_blocks, parts = blobs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n_blocks > 4 * parts:  # no more than about four blocks for a task
        blobs, known = blobs.repartition(-(-n_blocks // 4), "block"), known.repartition(-(-n_blocks // 4), "of_block")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, share, n, v = model.value
        out = []
        for size, blob in zip(left.column("size").to_pylist(), left.column("blob"), strict=True):
            d = _unpack(blob.as_buffer(), size)
            per, flat, lengths = d["per"].astype(np.int64), d["flat"], d["lengths"]
            c = np.zeros(len(per))
            c[right.column("local").to_numpy()] = right.column("c").to_numpy()
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            of_word = np.log((c + 0.5) / (n + 0.5 * (v + 1)))
            base = np.add.reduceat(of_word[flat], begin) / np.log(10)
            n_known = np.add.reduceat((c > 0)[flat].astype(np.int64), begin)
            at = np.concatenate([[0], np.cumsum(per)[:-1]])
            total = np.zeros(len(lengths))
            for lo, hi in _runs(lengths, RUN_WORDS):  # documents in runs of bounded size
                w = flat[begin[lo] : begin[hi - 1] + lengths[hi - 1]]
                k = per[w]
                place = np.cumsum(k) - k
                ids = d["ids"][np.repeat(at[w] - place, k) + np.arange(k.sum())].astype(np.int64)
                opens = np.concatenate([place, [k.sum()]])[begin[lo:hi] - begin[lo]]
                sizes = np.diff(np.concatenate([opens, [k.sum()]]))
                like = np.add.reduceat(log_likelihood(tables, ids, np.repeat(opens, sizes), share), place)
                if word_share:
                    like = np.logaddexp(like + np.log(1 - word_share), of_word[w] + np.log(word_share))
                total[lo:hi] = np.add.reduceat(like, begin[lo:hi] - begin[lo]) / np.log(10)
            out.append(pa.Table.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(d["held"]), pa.array(lengths.astype(np.int64)), pa.array(n_known), pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(total)], schema=arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return blobs.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(block, schema)


def _runs(lengths: np.ndarray, most: int):
    """(first, end) of runs of documents of about ``most`` words; a longer document is a run of its own."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if len(lengths):
        yield lo, len(lengths)
