"""Log-likelihood of whole texts under a gated recurrent language model with a class-factored softmax.

Tokens are ASCII-lower-cased words and one end mark per text. The probability of a token is
P(class | history) * P(member | class, history) * P(word | class, member):

* the class of a word is its own if it is one of the most frequent words, else that of its last two bytes, else the
  remainder; the end mark has a class of its own. So every word, seen or not, has a class;
* the members of a class are its most frequent words and one slot for all others. Both softmaxes read the state of a
  gated recurrent unit, trained in numpy by truncated backpropagation over windows whose state is carried on and begins
  anew with each text. Scoring carries the state through the whole text;
* a word in the slot for others has its share of their corpus counts plus `smooth`, with one share for all words that
  are new to the class. Only this factor doesn't see the history.

Counts and weights come from all training rows. These are dealt over rounds by a hash of their text; in a round every
partition trains the common weights on all its texts of that round, holding about `fit_tokens` tokens at a time, and
returns weights of fixed size; tasks add these up, weighted by tokens, and the average is what the next round begins with. So the weights depend on how rows lie in partitions, as any stochastic
training does on their order. Counts of the most
frequent words (`head_words` at most: all that occur as often as a threshold, found from a histogram of counts) are
broadcast; all other words meet their counts in a shuffled join.

Defined results: a null or empty text has no words, only the end mark. Rows with a null id belong to the training rows.
Every row is scored and, if it trains, counted by itself, whatever its id: repeated rows count each time and get equal
scores. Without training rows, all tokens are new and all weights are as they begin. An empty table gives an empty
table; other columns take no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import bounded_batches, crc_mod, settle
from .wordhash import Words, slices, text_buffers

HEAD_WORDS = 200_000
FIT_TOKENS = 1_500_000
#: Tokens, as pairs of two bytes, that wait in a task to be scored side by side: few texts at a time leave few streams
#: where one is long.
SCORE_TOKENS = 2_000_000
OWN_CLASSES, END_CLASSES = 31, 31  # frequent words, frequent endings; then the remainder and the end mark
MEMBERS = 24  # words of a class that the softmax tells apart
RATES = (0.04, 0.02)  # of the rounds over which training rows are dealt; weights are averaged after each
STATE = 16
WINDOW = 32
STREAMS = 384
#: Steps whose softmax over classes is held at a time.
BLOCK = 4
SMOOTH = 0.1
#: Bins a doubling of the histogram of counts.
BINS = 16
#: What stands for the end mark among words: no word holds a line feed.
END = b"\n"


class ClassMap:
    """Classes of words (own, by ending, remainder, end mark) and their places among the members of their class."""

    def __init__(self, own: list[bytes], endings: list[int], frequent: list[bytes] = (), most: int = MEMBERS):
        """frequent: words in falling order of counts, from which the members of each class are taken."""
        self.table = np.full(65536, len(own) + len(endings), np.int16)
        self.table[endings] = len(own) + np.arange(len(endings))
        self.rest = len(own) + len(endings)
        self.end = self.rest + 1
        self.size = self.end + 1
        self.own = {w: i for i, w in enumerate(own)}
        self.members: dict[bytes, tuple[int, int]] = {}
        self.sizes = [1] * self.size
        for w in frequent:
            if w != END and w not in self.own and self.sizes[c := int(self.table[ending(w)])] <= most:
                self.members[w] = c, self.sizes[c]
                self.sizes[c] += 1
        known = {w: (c, 0) for w, c in self.own.items()} | self.members
        joined = b" ".join([*known, b""])
        h = Words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)])).hash if known else np.zeros(0, np.uint64)
        order = np.argsort(h)
        self.known = h[order], np.array(list(known.values()), np.int64).reshape(-1, 2)[order]

    def of_word(self, w: bytes) -> tuple[int, int]:
        """Class and place of a word; place 0 in a class of several stands for all words that are no members."""
        if w == END:
            return self.end, 0
        if w in self.own:
            return self.own[w], 0
        return self.members.get(w) or (int(self.table[ending(w)]), 0)

    def of_words(self, words: Words) -> np.ndarray:
        """(2, words): classes and places of all words of a slice."""
        d, length = words.data, words.end - words.start
        last = d[words.end - 1].astype(np.int64)
        before = np.where(length > 1, d[np.maximum(words.end - 2, 0)], 0).astype(np.int64)
        out = np.zeros((2, len(length)), np.int16)
        out[0] = self.table[before * 256 + last]
        hashes, places = self.known
        if len(hashes):
            at = np.searchsorted(hashes, words.hash)
            at[at == len(hashes)] = 0
            hit = hashes[at] == words.hash
            out[:, hit] = places[at[hit]].T
        return out


def ending(w: bytes) -> int:
    return (w[-2] if len(w) > 1 else 0) * 256 + w[-1]


class Gru:
    """A gated recurrent unit over class ids, with a softmax over classes and one over the members of each class, both on
    the unit's state. Arrays have the batch last, so that steps and sums run along it."""

    def __init__(self, sizes: list[int], state: int, seed: int = 7):
        """sizes: the members of each class."""
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        classes, n = len(sizes), state
        self.first = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        self.inner = np.flatnonzero(np.asarray(sizes) > 1).tolist()
        members = int(self.first[-1])
        zeros = lambda *shape: np.zeros(shape, np.float32)
        self.p = {"g": f(2 * n, classes + 1, s=0.3), "i": f(n, classes + 1, s=0.3), "u": f(2 * n, n, s=0.3), "c": f(n, n, s=0.3), "o": f(classes, n, s=0.1), "b": zeros(classes), "w": zeros(members, n), "d": zeros(members)}
        self.state = state
        self.start = classes  # the input before the first token

    def forward(self, x: np.ndarray, h: np.ndarray, keep: bool = False):
        """x: inputs (time, batch), where `start` begins a text anew; h: (state, batch). Returns states (time, state,
        batch), the last one, and what backward needs: earlier states, gates, reset states and candidates, by time."""
        p, n = self.p, self.state
        steps, b = x.shape
        begins = x == self.start
        some = begins.any(1)
        held = lambda rows: np.empty((steps if keep else 1, rows, b), h.dtype)
        out, gates, resets, candidates = np.empty((steps, n, b), h.dtype), held(2 * n), held(n), held(n)
        before = held(n) if keep else None
        for t in range(steps):
            if some[t]:
                h = h * ~begins[t]
            at = t if keep else 0
            g, rh, c = gates[at], resets[at], candidates[at]
            p["g"].take(x[t], 1, out=g, mode="clip")
            g += p["u"] @ h
            np.negative(g, g)
            np.exp(g, g)
            g += 1
            np.reciprocal(g, g)
            np.multiply(g[n:], h, out=rh)
            p["i"].take(x[t], 1, out=c, mode="clip")
            c += p["c"] @ rh
            np.tanh(c, c)
            new = np.subtract(c, h, out=out[t])
            new *= g[:n]
            new += h
            if keep:
                before[t] = h
            h = new
        return out, h, (before, gates, resets, candidates)

    @staticmethod
    def _weights(w: np.ndarray, d: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of logits (..., choices, batch) and their sums over the choices. States lie within -1 and 1, which
        bounds logits; these are shifted by their maximum only where that bound comes near a float's range."""
        y = w @ s
        y += d[:, None]
        if (np.abs(w).sum(1) + np.abs(d)).max() > 60:
            y -= y.max(-2, keepdims=True)
        np.exp(y, y)
        return y, y.sum(-2, keepdims=True)

    def _class_weights(self, s: np.ndarray):
        return self._weights(self.p["o"], self.p["b"], s)

    def _member_weights(self, c: int, s: np.ndarray):
        own = slice(self.first[c], self.first[c + 1])
        return self._weights(self.p["w"][own], self.p["d"][own], s)

    def class_probability(self, s: np.ndarray) -> np.ndarray:
        y, total = self._class_weights(s)
        return y / total

    def member_probability(self, c: int, s: np.ndarray) -> np.ndarray:
        y, total = self._member_weights(c, s)
        return y / total

    def _by_class(self, y: np.ndarray):
        """(class, places of its tokens) of the classes that have members to choose from."""
        order = np.argsort(y, kind="stable")
        cuts = np.searchsorted(y[order], np.arange(len(self.first)))
        return [(c, order[cuts[c] : cuts[c + 1]]) for c in self.inner if cuts[c] < cuts[c + 1]]

    def log_likelihood(self, s: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """(time, batch): log P(class | state) + log P(member | class, state). s is (time, state, batch)."""
        t, b = y.shape
        out = np.empty((t, b))
        for lo in range(0, t, BLOCK):  # so many steps at a time stay in a core's cache
            part = y[lo : lo + BLOCK]
            e, total = self._class_weights(s[lo : lo + BLOCK])
            out[lo : lo + BLOCK] = e[np.arange(len(part))[:, None], part, np.arange(b)[None, :]].astype(float) / total[:, 0]
        out = out.ravel()
        ks, flat = k.ravel(), np.ascontiguousarray(s.transpose(1, 0, 2)).reshape(self.state, -1)
        for c, at in self._by_class(y.ravel()):
            e, total = self._member_weights(c, flat.take(at, 1))
            out[at] *= e[ks[at], np.arange(len(at))].astype(float) / total[0]
        return np.log(out).reshape(t, b)

    def gradients(self, x, y, k, valid, h):
        p, n = self.p, self.state
        s, last, (before, gates, resets, candidates) = self.forward(x, h, keep=True)
        steps, b = x.shape
        ys, ks = y.ravel(), k.ravel()
        scale = (valid / max(1, valid.sum())).astype(s.dtype)
        ds = np.empty_like(s)
        g = {k: np.zeros_like(p[k]) for k in ("o", "b", "w", "d")}
        for lo in range(0, steps, BLOCK):
            now = slice(lo, lo + BLOCK)
            prob, total = self._class_weights(s[now])
            prob *= scale[now, None, :] / total
            prob[np.arange(len(prob))[:, None], y[now], np.arange(b)[None, :]] -= scale[now]
            ds[now] = p["o"].T @ prob
            g["o"] += (prob @ s[now].transpose(0, 2, 1)).sum(0)
            g["b"] += prob.sum((0, 2))
        flat, more = np.ascontiguousarray(s.transpose(1, 0, 2)).reshape(n, -1), np.zeros((n, steps * b), s.dtype)
        for c, at in self._by_class(ys):
            lo, hi = self.first[c], self.first[c + 1]
            own = flat.take(at, 1)
            q, total = self._member_weights(c, own)
            share = scale.ravel()[at]
            q *= share / total
            q[ks[at], np.arange(len(at))] -= share
            g["w"][lo:hi] = q @ own.T
            g["d"][lo:hi] = q.sum(1)
            more[:, at] = p["w"][lo:hi].T @ q
        ds += more.reshape(n, steps, b).transpose(1, 0, 2)
        # What the steps back multiply by, for the whole window: none of it depends on a later step.
        z, r = gates[:, :n], gates[:, n:]
        keeps = 1 - z
        to_candidate = 1 - candidates * candidates
        to_candidate *= z
        to_update = candidates - before
        to_update *= z
        to_update *= keeps
        to_reset = (1 - r) * r
        to_reset *= before
        d, dc = np.empty((steps, 2 * n, b), s.dtype), np.empty((steps, n, b), s.dtype)
        dh = np.zeros_like(h)
        begins = x == self.start
        some = begins.any(1)
        ut, ct = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["c"].T)
        for t in reversed(range(steps)):
            dh += ds[t]
            np.multiply(dh, to_candidate[t], out=dc[t])
            np.multiply(dh, to_update[t], out=d[t, :n])
            back = ct @ dc[t]
            np.multiply(back, to_reset[t], out=d[t, n:])
            dh *= keeps[t]
            back *= r[t]
            dh += back
            dh += ut @ d[t]
            if some[t]:
                dh *= ~begins[t]
        g["c"] = (dc @ resets.transpose(0, 2, 1)).sum(0)
        g["u"] = (d @ before.transpose(0, 2, 1)).sum(0)
        inputs = x.ravel()
        order = np.argsort(inputs, kind="stable")
        found, at = np.unique(inputs[order], return_index=True)
        for name, part in (("g", d), ("i", dc)):
            g[name] = np.zeros_like(p[name])
            by_row = np.ascontiguousarray(part.transpose(1, 0, 2)).reshape(part.shape[1], -1)
            g[name][:, found] = np.add.reduceat(by_row.take(order, 1), at, axis=1)
        return g, last

    def fit(self, texts_: list[np.ndarray], window: int = WINDOW, batch: int = 128, epochs: int = 1, rate: float = 0.01) -> None:
        """Truncated backpropagation: texts, each (2, tokens), one after another in `batch` streams; the state is carried
        from window to window and begins anew with each text."""
        if not hasattr(self, "moments"):  # kept from call to call
            self.moments = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
            self.step = 0
        m, v = self.moments
        streams: list[list[np.ndarray]] = [[] for _ in range(batch)]
        size = np.zeros(batch, np.int64)
        for t in sorted(texts_, key=lambda t: t.shape[1], reverse=True):
            i = int(size.argmin())
            streams[i].append(t)
            size[i] += t.shape[1]
        if not size.max():
            return
        # Streams by falling length, side by side: in each window only those that go on are computed and held.
        order = np.argsort(-size, kind="stable")
        length, total = size[order], int(size.max())
        laid = [t for i in order for t in streams[i]]
        end = np.cumsum(length)
        begin = end - length
        y, k = np.concatenate(laid, 1).astype(np.int16)
        x = np.r_[np.int16(self.start), y[:-1]]
        heads = np.cumsum([0, *(t.shape[1] for t in laid)])[:-1]
        x[heads[heads < len(x)]] = self.start
        for epoch in range(epochs):
            h = np.zeros((self.state, batch), np.float32)
            for at in range(0, total, window):
                live, steps = int((length > at).sum()), min(window, total - at)
                place = begin[:live] + at + np.arange(steps)[:, None]
                valid = place < end[:live]
                place = np.where(valid, place, 0)
                g, h = self.gradients(x[place], y[place], k[place], valid, np.ascontiguousarray(h[:, :live]))
                self.step += 1
                step = self.step
                norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                lr = rate * min(1, step / 20) * (0.4**epoch) * float(valid.sum() / (steps * batch))  # few streams that go on alone move little
                for name in self.p:
                    a = g[name] * min(1.0, 1.0 / max(norm, 1e-9))
                    m[name] += 0.1 * (a - m[name])
                    v[name] += 0.01 * (a * a - v[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def score(self, texts_: list[np.ndarray], width: int = 512, window: int = WINDOW) -> np.ndarray:
        """Natural-log likelihood of the classes and places of each text, state carried through all its windows."""
        out = np.zeros(len(texts_))
        if not texts_:
            return out
        length = np.array([t.shape[1] for t in texts_])
        begin = np.r_[0, np.cumsum(length)]
        flat = np.concatenate(texts_, 1).astype(np.int16)
        before = np.r_[np.int16(self.start), flat[0, :-1]]
        before[begin[:-1][length > 0]] = self.start
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), width):
            group = order[lo : lo + width]  # longest first, so that ended texts leave at the end of the batch
            h = np.zeros((self.state, len(group)), np.float32)
            for at in range(0, int(length[group[0]]), window):
                live = int((length[group] > at).sum())
                steps = min(window, int(length[group[0]]) - at)
                place = begin[group[:live]][None, :] + at + np.arange(steps)[:, None]
                valid = place < begin[group[:live] + 1][None, :]
                place = np.where(valid, place, 0)
                s, h, _ = self.forward(before[place], np.ascontiguousarray(h[:, :live]))
                out[group[:live]] += np.where(valid, self.log_likelihood(s, flat[0, place], flat[1, place]), 0).sum(0)
        return out


def _class_texts(words: Words, classes: ClassMap) -> list[np.ndarray]:
    end = np.array([[classes.end], [0]], np.int16)
    return [np.concatenate([x, end], 1) for x in np.split(classes.of_words(words), words.first[1:-1], 1)]


def _round(texts_: DataFrame, classes: ClassMap, weights: dict[str, np.ndarray], rate: float, held: int) -> dict[str, np.ndarray]:
    """Weights after one round over some texts: trained in each partition, averaged by tokens. Without texts, as they were."""
    shared = texts_.sparkSession.sparkContext.broadcast((classes, weights))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, weights = shared.value
        gru = Gru(classes.sizes, STATE)
        gru.p = {k: w.copy() for k, w in weights.items()}
        kept: list[np.ndarray] = []
        size = done = 0

        def fit():
            gru.fit(kept, batch=max(8, min(STREAMS, size // (60 * WINDOW))), epochs=1, rate=rate)
            kept.clear()

        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off):
                part = _class_texts(Words(data, off[lo : hi + 1], lower=True), classes)
                kept += part
                size += sum(t.shape[1] for t in part)
                if size >= held:
                    fit()
                    done, size = done + size, 0
        if size:
            fit()
        if done + size:
            flat = np.concatenate([gru.p[k].ravel() for k in sorted(gru.p)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([done + size], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["tokens", "weights"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(sum(w.size for w in weights.values())), 0
        for batch in batches:
            for n, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += n * np.frombuffer(w, np.float32).astype(float)
                tokens += n
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype(np.float32).tobytes()], pa.binary())], ["tokens", "weights"])

    # One row a partition, added in as many tasks as the root of their number, and then in one.
    schema = "tokens long, weights binary"
    each = settle(texts_.mapInArrow(train, schema))
    some = each.repartition(max(1, math.isqrt(each.count()))).mapInArrow(added, schema)
    mean = some.coalesce(1).mapInArrow(added, schema).head()
    out, at = {}, 0
    flat = np.frombuffer(mean["weights"], np.float32) if mean else np.concatenate([weights[k].ravel() for k in sorted(weights)])
    for k in sorted(weights):
        w = weights[k]
        out[k] = flat[at : at + w.size].reshape(w.shape).copy()
        at += w.size
    return out


def scored(docs: DataFrame, train: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, fit_tokens: int = FIT_TOKENS, score_tokens: int = SCORE_TOKENS) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    train: which rows to learn from; by default those whose crc32(id as text) mod 10 is not 0."""
    learn = F.coalesce(crc_mod(F.col(id_col), 10) != 0, F.lit(True)) if train is None else train
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (~learn).alias("held_out"))
    spark = rows.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in slices(off):
                for i in range(lo, hi):
                    counts.update(data[off[i] : off[i + 1]].tobytes().lower().split())
                counts[END] += hi - lo
                if len(counts) > 400_000:
                    yield flush()
        if counts:
            yield flush()

    counts = settle(rows.where(~F.col("held_out")).select("text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    # The most frequent words by a threshold on their counts: a histogram first, so that no task sorts them all.
    at = F.floor(F.log2("c") * BINS).cast("int")
    seen, least = 0, None
    for r in sorted(counts.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["bin"]):  # some hundred bins
        seen += r["n"]
        if seen > head_words:
            break
        least = r["bin"]
    head = counts.where(at >= least).toArrow() if least is not None else None  # head_words rows at most
    pairs = [] if head is None else zip(head.column("word").to_pylist(), head.column("c").to_pylist(), strict=True)
    head_counts = dict(sorted(pairs, key=lambda wc: (-wc[1], wc[0])))
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).select("c").head()
    if ends:  # the end mark is always at hand, however small the head
        head_counts[END] = ends["c"]
    own = [w for w in list(head_counts)[: OWN_CLASSES + 1] if w != END][:OWN_CLASSES]
    tails: Counter = Counter()
    for w, c in head_counts.items():
        if w != END:
            tails[ending(w)] += c
    classes = ClassMap(own, [e for e, _ in tails.most_common(END_CLASSES)], list(head_counts))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(classes.size, np.int64), np.zeros(classes.size, np.int64)
        for batch in batches:
            k = np.array([classes.of_word(w)[0] for w in batch.column(0).to_pylist()], np.int64)
            n += np.bincount(k, batch.column(1).to_numpy(), classes.size).astype(np.int64)
            v += np.bincount(k, minlength=classes.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.size)), pa.array(n), pa.array(v)], ["class", "n", "v"])

    found = counts.mapInArrow(by_class, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n_class, v_class = np.zeros(classes.size), np.zeros(classes.size)
    for r in found:  # one row a class
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    n_all, v_all = int(n_class.sum()), int(v_class.sum())

    gru = Gru(classes.sizes, STATE)
    gru.p["b"] = np.log((n_class + SMOOTH) / (n_all + SMOOTH * classes.size)).astype(np.float32)  # begin with the classes' shares
    others = n_class + SMOOTH * (v_class - np.array(classes.sizes) + 2)  # counts of what is no member, and a share for new words
    for w, (c, k) in classes.members.items():  # and with the members' shares
        others[c] -= head_counts[w]
        gru.p["d"][gru.first[c] + k] = np.log(head_counts[w] + SMOOTH)
    gru.p["d"][gru.first[:-1]] = np.log(others)
    lone = np.r_[np.arange(len(classes.own)), classes.end]
    others[lone] = 1  # a class of one word holds no others
    texts_ = rows.where(~F.col("held_out")).select("text")
    dealt = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(len(RATES)))
    for i, rate in enumerate(RATES) if n_all else ():
        gru.p = _round(texts_.where(dealt == i), classes, gru.p, rate, fit_tokens)
    # Logarithm of the count that a member or a lone word has in `sums`, by class and place; others' by class alone.
    told = np.zeros((classes.size, max(classes.sizes)))
    for w, (c, k) in classes.members.items():
        told[c, k] = np.log10(head_counts[w] + SMOOTH)
    for w, c in classes.own.items():
        told[c, 0] = np.log10(head_counts[w] + SMOOTH)
    told[classes.end, 0] = np.log10(head_counts.get(END, 0) + SMOOTH)
    several = np.ones(classes.size, bool)
    several[lone] = False
    told[several, 0] = np.log10(others[several])
    shared = spark.sparkContext.broadcast((head_counts, classes, gru, told))

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of each text with what head words and classes give; a row of each of its words outside the head."""
        head_counts, classes, gru, told = shared.value
        logs = dict(zip(head_counts, np.log10(np.fromiter(head_counts.values(), float, len(head_counts)) + SMOOTH).tolist(), strict=True))
        end_log = logs.get(END, float(np.log10(SMOOTH)))
        columns = ["key", "doc_id", "held_out", "word", "n", "known", "sums", "rest"]
        sequences: list[np.ndarray] = []  # of the rows in waiting; no texts are held
        waiting: list[tuple] = []
        held = 0

        def judged():
            history, at = gru.score(sequences, width=1024) / np.log(10), 0
            for key, doc, out, n, known, sums, spread in waiting:
                rest, at = history[at : at + len(n)] - spread, at + len(n)
                yield pa.RecordBatch.from_arrays([key, doc, out, pa.nulls(len(n), pa.binary()), pa.array(n), pa.array(known), pa.array(sums), pa.array(rest)], columns)
            sequences.clear()
            waiting.clear()

        for batch in batches:
            data, off = text_buffers(batch.column(2))
            spread, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for lo, hi in slices(off):
                part = _class_texts(Words(data, off[lo : hi + 1], lower=True), classes)
                spread[lo:hi] = [told[t[0], t[1]].sum() for t in part]
                n[lo:hi] = [t.shape[1] for t in part]
                sequences += part
            sums = np.zeros(batch.num_rows)
            known = np.zeros(batch.num_rows, np.int64)
            owner, word, times = [], [], []  # of words outside the head
            get = logs.get
            for i in range(batch.num_rows):
                found = data[off[i] : off[i + 1]].tobytes().lower().split()
                each = list(map(get, found))
                if none := each.count(None):
                    distinct = Counter([w for w, x in zip(found, each, strict=True) if x is None])
                    each = [x for x in each if x is not None]
                else:
                    distinct = {}
                sums[i], known[i] = end_log + math.fsum(each), len(found) - none + (END in logs)
                owner += [i] * len(distinct)
                word += distinct
                times += distinct.values()
                if len(word) > 100_000 or i == batch.num_rows - 1:
                    at, k = pa.array(owner, pa.int64()), len(word)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.array(word, pa.binary()), pa.array(times, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64())], columns)
                    owner, word, times = [], [], []
            waiting.append((batch.column(0), batch.column(1), batch.column(3), n, known, sums, spread))
            held += int(n.sum())
            if held >= score_tokens:
                yield from judged()
                held = 0
        if waiting:
            yield from judged()

    # The key is given once and settled, so that both parts of a row carry the same one.
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", "held_out")
    both = settle(keyed.mapInArrow(per_text, "key long, doc_id long, held_out boolean, word binary, n long, known long, sums double, rest double"))
    tail = both.where(F.col("word").isNotNull()).select("key", "word", "n").join(counts, "word", "left")
    tail_sums = tail.groupBy("key").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("also"))
    total = F.col("sums") + F.coalesce("more", F.lit(0.0))
    return (
        both.where(F.col("word").isNull())
        .join(tail_sums, "key", "left")
        .select(
            "doc_id",
            "held_out",
            F.col("n").alias("n_tokens"),
            (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (total - F.col("n") * F.lit(float(np.log10(n_all + SMOOTH * (v_all + 1))))).alias("base_score"),
            (total + F.col("rest")).alias("score"),
        )
    )
