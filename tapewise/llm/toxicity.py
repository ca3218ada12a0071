"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is the vector of the word (known ones; one for all others) plus the mean vector of its four-byte
sequences, its edges included. Overlapping windows of words run through a recurrent network in both directions;
attention pools its states, and a logistic output scores the window. A text's score is that of its highest window: every
window of the whole text is scored. The network is trained here, in numpy, on a bounded sample of labelled documents:
first on all their windows with the document's label, then, since a toxic text is toxic somewhere, on the highest
window of toxic texts and the highest windows of the others."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_texts, slices, tuck, untuck
from .tokens import LENGTH_MIX, POWERS, VALUES

WINDOW, STRIDE = 64, 48
EDGE = b"\xff \xff \xff"       # words that no text has, around each: so the network learns what an end is
EDGES = 2 * len(EDGE.split())
BUCKET_BITS = 14
WORD_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
THRESHOLD = 0.7


@dataclass
class Words:
    """Words of some texts: `which` has the distinct word of each occurrence; `begins` the first occurrence of each text, and the end."""
    which: np.ndarray
    begins: np.ndarray
    hashes: np.ndarray      # of distinct words
    sizes: np.ndarray       # bytes of distinct words
    grams: np.ndarray       # buckets of their byte sequences, one per byte


def words_of(texts: list[bytes]) -> Words:
    """Runs of ASCII letters and digits and of any other non-ASCII characters, A-Z lower-cased, between edges."""
    raw = np.frombuffer(b"\n" + b"".join(b"%b %b %b\n" % (EDGE, t.lower(), EDGE) for t in texts), np.uint8)
    inside = WORD_BYTES[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, stops = edges[0::2], edges[1::2]
    ends = np.cumsum([len(t) + 2 * len(EDGE) + 3 for t in texts])
    begins = np.searchsorted(starts, np.concatenate([[0], ends]))
    if not len(starts):
        return Words(np.empty(0, np.int64), begins, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    sizes = stops - starts
    first = starts[0]
    span, offsets = raw[first:stops[-1]], starts - first
    place = np.arange(len(span)) - np.repeat(offsets, np.diff(np.append(offsets, len(span))))
    terms = np.where(inside[first:stops[-1]], VALUES[span] * POWERS[place % (len(POWERS) - 1)], np.uint64(0))
    keys = np.add.reduceat(terms, offsets) + sizes.astype(np.uint64) * LENGTH_MIX
    hashes, at, which = np.unique(keys, return_index=True, return_inverse=True)
    sizes, source = sizes[at], starts[at]
    # Distinct words with zeros between them; the four bytes from the one before each of a word's bytes.
    total = int(sizes.sum())
    ramp = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    target = np.cumsum(sizes + 2) - sizes - 1
    padded = np.zeros(total + 2 * len(sizes) + 4, np.uint32)
    padded[np.repeat(target, sizes) + ramp] = raw[np.repeat(source, sizes) + ramp]
    at = np.repeat(target - 1, sizes) + ramp
    code = padded[at] | padded[at + 1] << np.uint32(8) | padded[at + 2] << np.uint32(16) | padded[at + 3] << np.uint32(24)
    grams = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return Words(which, begins, hashes, sizes, grams.astype(np.int64))


def all_words(texts: list[bytes], limit: int = 1 << 20) -> Words:
    """As `words_of`, over slices of about `limit` bytes: what is kept is little beside the arrays that each needs."""
    parts, held = [[]], 0
    for t in texts:
        if held > limit:
            parts.append([])
            held = 0
        parts[-1].append(t)
        held += len(t)
    found = [words_of(p) for p in parts]
    hashes, at, inverse = np.unique(np.concatenate([w.hashes for w in found]), return_index=True, return_inverse=True)
    base = np.cumsum([0] + [len(w.hashes) for w in found])
    which = np.concatenate([inverse[b + w.which].astype(np.int32) for b, w in zip(base, found)])
    begins = np.concatenate([[0]] + [w.begins[1:] for w in found])
    counts = np.cumsum([0] + [len(w.which) for w in found])
    begins[1:] += np.repeat(counts[:-1], [len(p) for p in parts])
    sizes, grams = np.concatenate([w.sizes for w in found]), np.concatenate([w.grams for w in found])
    own, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
    return Words(which, begins, hashes, own, grams[np.repeat(first - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))])


def windows_of(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of all windows, edges included: every STRIDE words, and the last WINDOW words of a text.
    A text without a word of its own has none."""
    n = np.diff(begins)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > EDGES).astype(n.dtype))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return begins[:-1][text] + first, np.minimum(n[text], WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def scatter(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by index."""
    out, order = np.zeros((n, values.shape[1]), values.dtype), np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out[ordered[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def recur(gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, u: np.ndarray, backward: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States (windows, steps, hidden) of one direction. gates: of distinct words."""
    size, steps, h = u.shape[0], index.shape[1], np.zeros((len(index), u.shape[0]), u.dtype)
    out, trace = np.empty((len(index), steps, size), u.dtype), []
    for t in (range(steps - 1, -1, -1) if backward else range(steps)):
        g, v = gates[index[:, t]], h @ u
        zr = sigmoid(g[:, :2 * size] + v[:, :2 * size])
        z, r = zr[:, :size], zr[:, size:]
        n = np.tanh(g[:, 2 * size:] + r * v[:, 2 * size:])
        after = n + z * (h - n)
        if mask is not None:
            after = np.where(mask[:, t, None], after, h)
        if keep:
            trace.append((t, h, z, r, n, v[:, 2 * size:]))
        h = out[:, t] = after
    return out, trace


def unroll(d_out: np.ndarray, trace: list, index: np.ndarray, mask: np.ndarray, u: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates of distinct words and of u."""
    d_in, d_u = np.empty((*index.shape, u.shape[1]), u.dtype), np.zeros_like(u)
    dh = np.zeros_like(d_out[:, 0])
    for t, h, z, r, n, v in reversed(trace):
        dh = dh + d_out[:, t]
        live = mask[:, t, None]
        da = np.where(live, dh, 0)
        dn = da * (1 - z) * (1 - n * n)
        dz, dr = da * (h - n) * z * (1 - z), dn * v * r * (1 - r)
        d_in[:, t] = np.concatenate([dz, dr, dn], axis=1)
        dv = np.concatenate([dz, dr, dn * r], axis=1)
        d_u += h.T @ dv
        dh = np.where(live, da * z, dh) + dv @ u.T
    return scatter(index.ravel(), d_in.reshape(-1, u.shape[1]), distinct), d_u


@dataclass
class Network:
    """Parameters, and the hashes of the words that have a vector of their own (sorted; vector 0 is for all others)."""
    known: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, known: np.ndarray, width: int = 16, hidden: int = 12, attention: int = 8, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"word": 0.1 * draw(1, (len(known) + 1) * width).reshape(-1, width), "gram": 0.1 * draw(1, (1 << BUCKET_BITS) * width).reshape(-1, width)}
        for side in "fb":
            p |= {f"w{side}": draw(width, 3 * hidden), f"u{side}": draw(hidden, 3 * hidden), f"b{side}": np.zeros(3 * hidden, np.float32)}
        return cls(np.sort(known), p | {"wa": draw(2 * hidden, attention), "ba": np.zeros(attention, np.float32), "va": draw(attention),
                                        "wo": draw(2 * hidden), "bo": np.zeros(1, np.float32)})

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vector of each word: its place among the known ones, from 1, or 0."""
        at = np.searchsorted(self.known, hashes)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == hashes[found]
        return np.where(found, at + 1, 0)

    def inputs(self, numbers: np.ndarray, sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out, ends = self.p["word"][numbers], np.cumsum(sizes)
        for i in range(0, len(sizes), 1 << 15):         # blocks: a word has a vector per byte
            part = slice(i, i + (1 << 15))
            begin = (ends - sizes)[part]
            sums = np.add.reduceat(self.p["gram"][grams[begin[0]:ends[part][-1]]], begin - begin[0], axis=0)
            out[part] += sums / sizes[part, None].astype(np.float32)
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False) -> tuple[np.ndarray, tuple]:
        p = self.p
        sides = [recur(x @ p[f"w{s}"] + p[f"b{s}"], index, mask, p[f"u{s}"], s == "b", keep) for s in "fb"]
        states = np.concatenate([s[0] for s in sides], axis=2)
        act = np.tanh(states @ p["wa"] + p["ba"])
        score = act @ p["va"]
        if mask is not None:
            score = np.where(mask, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.matmul(weight[:, None, :], states)[:, 0]
        return pooled @ p["wo"] + p["bo"][0], (sides, states, act, weight, pooled)

    def gradients(self, numbers: np.ndarray, sizes: np.ndarray, grams: np.ndarray, index: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of windows over distinct words (numbers, sizes, grams)."""
        p, x = self.p, self.inputs(numbers, sizes, grams)
        logit, (sides, states, act, weight, pooled) = self.forward(x, index, mask, keep=True)
        dl = ((sigmoid(logit) - labels) / len(labels)).astype(x.dtype)
        g = {"wo": pooled.T @ dl, "bo": dl.sum(keepdims=True)}
        dp = dl[:, None] * p["wo"]
        dw = np.matmul(states, dp[:, :, None])[:, :, 0]
        ds = weight * (dw - (dw * weight).sum(axis=1, keepdims=True))
        da = ds[:, :, None] * p["va"] * (1 - act * act)
        g |= {"va": (act * ds[:, :, None]).sum(axis=(0, 1)), "ba": da.sum(axis=(0, 1)), "wa": np.tensordot(states, da, ((0, 1), (0, 1)))}
        d_states = weight[:, :, None] * dp[:, None, :] + da @ p["wa"].T
        dx, hidden = np.zeros_like(x), p["uf"].shape[0]
        for k, s in enumerate("fb"):
            dg, g[f"u{s}"] = unroll(d_states[:, :, k * hidden:(k + 1) * hidden], sides[k][1], index, mask, p[f"u{s}"], len(x))
            g |= {f"w{s}": x.T @ dg, f"b{s}": dg.sum(axis=0)}
            dx += dg @ p[f"w{s}"].T
        each = np.repeat(dx / sizes[:, None].astype(x.dtype), sizes, axis=0)
        return g | {"word": scatter(numbers, dx, len(p["word"])), "gram": scatter(grams, each, len(p["gram"]))}

    def window_scores(self, words: Words, first: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probabilities of windows."""
        out = np.empty(len(first), np.float32)
        if not len(first):
            return out
        x, steps = self.inputs(self.numbers(words.hashes), words.sizes, words.grams), np.arange(WINDOW)
        full = size == WINDOW
        for part in (np.flatnonzero(full), np.flatnonzero(~full)):
            part = part[np.argsort(size[part], kind="stable")]
            for i in range(0, len(part), block):
                some = part[i:i + block]
                long = int(size[some].max())
                index = words.which[np.minimum(first[some][:, None] + steps[:long], len(words.which) - 1)]
                mask = None if full[some[0]] else steps[:long] < size[some][:, None]
                out[some] = sigmoid(self.forward(x, index, mask)[0])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of whole texts: the highest of all their windows; 0 for a text without a word."""
        words = words_of(texts)
        first, size, text = windows_of(words.begins)
        out = np.zeros(len(texts))
        np.maximum.at(out, text, self.window_scores(words, first, size))
        return out


def train(texts: list[bytes], labels: np.ndarray, steps: tuple[int, int] = (100, 300), batch: int = 128, rate: float = 5e-3,
          known_words: int = 4096, seed: int = 5) -> Network | None:
    """A network from texts and 0/1 labels; None unless there are both kinds. Words in three texts or more get vectors,
    the `known_words` most frequent ones at most."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng, words = np.random.default_rng(seed), all_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.begins))
    held = np.bincount(np.unique(words.which.astype(np.int64) * len(texts) + owner) // len(texts), minlength=len(words.hashes))
    often = np.argsort(-held, kind="stable")[:known_words]
    net = Network.new(words.hashes[often[held[often] >= 3]])
    numbers, offsets, ramp = net.numbers(words.hashes), np.cumsum(words.sizes) - words.sizes, np.arange(WINDOW)
    first, size, text = windows_of(words.begins)
    m, v, step = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0
    positive = labels[text] == 1
    for kind, until in enumerate(np.cumsum(steps)):
        while step < until:
            if kind == 0:       # all windows, as many of either kind
                less = min(positive.sum(), (~positive).sum(), batch * steps[0] // 2)
                chosen = np.concatenate([rng.choice(np.flatnonzero(q), less, replace=False) for q in (positive, ~positive)])
            else:               # the highest window of each text
                score = net.window_scores(words, first, size) + 1e-6 * rng.random(len(first))
                order = np.lexsort((-score, text))
                chosen = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
            rng.shuffle(chosen)
            for some in np.array_split(chosen, max(1, len(chosen) // batch))[:until - step]:
                mask = ramp[:size[some].max()] < size[some][:, None]
                raw = words.which[np.minimum(first[some][:, None] + ramp[:mask.shape[1]], len(words.which) - 1)]
                # Some clean windows get their words in runs: repetition says nothing.
                runs = np.flatnonzero(~positive[some] & (rng.random(len(some)) < 0.2))
                raw[runs] = raw[runs[:, None], ramp[:mask.shape[1]] // rng.choice([2, 8, 32], len(runs))[:, None]]
                distinct, index = np.unique(raw, return_inverse=True)
                own = words.sizes[distinct]
                grams = words.grams[np.repeat(offsets[distinct] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
                # Known words lose their own vector at times, so that characters are learned too.
                own_numbers = np.where(rng.random(len(distinct)) < 0.3, 0, numbers[distinct])
                g = net.gradients(own_numbers, own, grams, index.reshape(raw.shape), mask, labels[text[some]].astype(np.float32))
                step += 1
                for name, a in net.p.items():
                    m[name] += 0.1 * (g[name] - m[name])
                    v[name] += 0.001 * (g[name] * g[name] - v[name])
                    a -= rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 1 when divided by 3. A null id leaves 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 4000, sample_bytes: int = 1 << 26) -> Network | None:
    """A network from at most `toxic` and `clean` labelled documents (those with the smallest hash) that are not held
    out: one task trains on them, the driver gets the parameters. The sample is bounded in bytes too: texts of over a
    64th of `sample_bytes` are not learned from, nor what exceeds that sum in the order of the hash."""
    free = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = None
    for kind, sample in ((0, clean), (1, toxic)):
        some = free.filter(F.col("toxic") == kind).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "toxic", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).filter(
        F.octet_length("text") <= sample_bytes // 64).orderBy(F.xxhash64("doc_id", "text")).limit(toxic + clean)
    so_far = Window.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("_sum", F.sum(F.octet_length("text")).over(so_far)).filter(F.col("_sum") <= sample_bytes).drop("_sum")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text"))))     # at most as many
        if rows:
            network = train([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)])], ["network"])

    made = found.coalesce(1).mapInArrow(fit, "network binary").collect()
    return pickle.loads(bytes(made[0].network)) if made else None


def score(docs: DataFrame, network: Network | None, keep_text: bool = False) -> DataFrame:
    """`docs` (text, other columns), without text unless it is to be kept, with `score`; columns of that name are
    replaced. Without a network every score is 0; a null text or one without a word has 0."""
    given = docs.drop("score")
    docs = tuck(given, "text")
    kept = docs.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for lo, hi in slices(text, 1 << 20):
                part = text.slice(lo, hi - lo)
                scores = np.zeros(hi - lo) if network is None else network.scores(byte_texts(part))
                columns = {c: batch.column(c).slice(lo, hi - lo) for c in kept} | ({"text": part} if keep_text else {}) | {"score": pa.array(scores)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = StructType([*[docs.schema[c] for c in kept], *[docs.schema["text"]] * keep_text, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema).select(*untuck(docs, given, *(() if keep_text else ("text",))), "score")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_text: bool = False) -> DataFrame:
    """Scored documents with held_out and predicted (1 if the score reaches `threshold`, else 0)."""
    scored = score(docs.drop("held_out", "predicted"), learn(docs, labels), keep_text)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": F.when(F.col("score") >= threshold, 1).otherwise(0)})
