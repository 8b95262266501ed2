"""Language identification: a bidirectional gated recurrent network over bytes.

A text is read as its UTF-8 bytes, in windows of ``CORE`` bytes; each window is read with up to
``CONTEXT`` bytes of the text before and after it, so the states at its edges know what stands
there.  Two gated recurrent layers read a window forwards and backwards, and at every byte a softmax
over both states labels that position.  A document's probabilities are the mean over all its
positions.  Windows of many texts are read in lockstep, the longest first, so a step is a few
vector operations and no padding is computed.

The network is trained in numpy by backpropagation through time, on a bounded sample: one passage
of ``SAMPLE_CHARS`` characters, at a place drawn by a hash, of about ``SAMPLE_DOCS`` labelled documents
of each language, drawn by a hash of the id, and ``SAMPLE_RUNS`` runs of ``RUN`` bytes of those
passages.  There is one output for each language that is labelled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN, RUN, CORE, CONTEXT = 16, 48, 480, 32
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_RUNS, EPOCHS = 400, 2_000, 24_000, 2
UNDETERMINED = "und"
#: Windows that are read at once, and bytes of texts that are held for it.
LANES, HELD_BYTES = 1024, 1 << 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name: for each direction the byte table ``t``, the recurrent weights ``u``
    and the output weights ``o``; one output bias."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(languages)
        self.languages = languages
        self.p = {"b": np.zeros(n, "f4")}
        for d in "fb":
            self.p |= {f"t{d}": rng.normal(0, 0.3, (256, 3 * h)).astype("f4"), f"u{d}": rng.normal(0, h**-0.5, (h, 3 * h)).astype("f4"), f"o{d}": rng.normal(0, h**-0.5, (h, n)).astype("f4")}

    def _layer(self, d: str, x: np.ndarray, keep: list | None) -> np.ndarray:
        h, table, u = HIDDEN, self.p[f"t{d}"], self.p[f"u{d}"]
        state = np.zeros((len(x), h), "f4")
        out = np.empty((x.shape[1], len(x), h), "f4")
        for i in range(x.shape[1]):
            into, rec = table[x[:, i]], state @ u
            zr = _sigmoid(into[:, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(into[:, 2 * h :] + r * rec[:, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, new, rec[:, 2 * h :]))
            state = new + z * (state - new)
            out[i] = state
        return out

    @staticmethod
    def _flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Column numbers that turn each row round within its length."""
        i = np.arange(x.shape[1])
        return np.where(i < lengths[:, None], lengths[:, None] - 1 - i, i)

    def positions(self, x: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities (position, run, language) of padded runs ``x``."""
        flip = self._flip(x, lengths)
        rows = np.arange(len(x))[:, None]
        kept = (None, None) if keep is None else ([], [])
        f = self._layer("f", x, kept[0])
        b = self._layer("b", x[rows, flip], kept[1])
        turned = b[flip.T, rows.T]
        logits = f @ self.p["of"] + turned @ self.p["ob"] + self.p["b"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        e /= e.sum(2, keepdims=True)
        if keep is not None:
            keep |= {"f": f, "turned": turned, "kept": kept, "flip": flip, "rows": rows}
        return e

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradients through time."""
        keep: dict = {}
        probs = self.positions(x, lengths, keep)
        real = (np.arange(x.shape[1])[:, None] < lengths).astype("f4")
        total = real.sum()
        at = np.take_along_axis(probs, y[None, :, None], 2)[:, :, 0]
        loss = float(-(np.log(at + 1e-9) * real).sum() / total)
        d = probs.copy()
        np.put_along_axis(d, y[None, :, None], at[:, :, None] - 1, 2)
        d *= (real / total)[:, :, None]
        flat = d.reshape(-1, d.shape[2])
        g = {"b": flat.sum(0), "of": keep["f"].reshape(-1, HIDDEN).T @ flat, "ob": keep["turned"].reshape(-1, HIDDEN).T @ flat}
        back = d @ self.p["ob"].T
        flip, rows = keep["flip"], keep["rows"]
        g |= self._back("f", x, d @ self.p["of"].T, keep["kept"][0])
        g |= self._back("b", x[rows, flip], back[flip.T, rows.T], keep["kept"][1])
        return loss, g

    def _back(self, d: str, x: np.ndarray, dout: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        h, u = HIDDEN, self.p[f"u{d}"]
        du, dstate = np.zeros_like(u), np.zeros((len(x), h), "f4")
        given = np.empty((x.shape[1], len(x), 3 * h), "f4")
        for i in range(x.shape[1] - 1, -1, -1):
            state, z, r, new, rec = kept[i]
            dstate = dstate + dout[i]
            dnew = dstate * (1 - z) * (1 - new * new)
            dz = dstate * (state - new) * z * (1 - z)
            dr = dnew * rec * r * (1 - r)
            given[i] = np.concatenate([dz, dr, dnew], 1)
            recurrent = np.concatenate([dz, dr, dnew * r], 1)
            du += state.T @ recurrent
            dstate = dstate * z + recurrent @ u.T
        seen = x.T.ravel()
        order = np.argsort(seen, kind="stable")
        kinds, first = np.unique(seen[order], return_index=True)
        dt = np.zeros_like(self.p[f"t{d}"])
        dt[kinds] = np.add.reduceat(given.reshape(-1, 3 * h)[order], first, axis=0)
        return {f"t{d}": dt, f"u{d}": du}


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in runs])
    width = int(lengths.max())
    return np.frombuffer(b"".join(r.ljust(width, b" ") for r in runs), "u1").reshape(len(runs), width), lengths


def train(samples: list[tuple[str, str]], seed: int = 7) -> Network | None:
    """A network from (text, language) pairs; None without any."""
    texts: dict[str, list[bytes]] = {}
    for text, lang in samples:
        if b := text.encode("utf-8", "replace"):
            texts.setdefault(lang, []).append(b)
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    net = Network(sorted(texts), seed)
    runs, labels, share = [], [], max(256, SAMPLE_RUNS // len(texts))
    for y, lang in enumerate(net.languages):
        ends = np.cumsum([len(b) for b in texts[lang]])
        for place in rng.integers(0, ends[-1], share):
            i = int(np.searchsorted(ends, place, "right"))
            at = int(place - (ends[i - 1] if i else 0))
            at = max(0, min(at, len(texts[lang][i]) - RUN))
            runs.append(texts[lang][i][at : at + RUN])
            labels.append(y)
    y = np.array(labels)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    lengths, step, size = np.array([len(r) for r in runs]), 0, 128
    total = EPOCHS * (-(-len(runs) // size))
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        for lo in range(0, len(order), 16 * size):  # batches of similar length
            block = order[lo : lo + 16 * size]
            block = block[np.argsort(lengths[block], kind="stable")]
            for a in range(0, len(block), size):
                pick = block[a : a + size]
                _, g = net.gradients(*padded([runs[i] for i in pick]), y[pick])
                step += 1
                rate = 0.02 * (1 - step / (total + 1))
                for k in net.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                    net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype("f4")
    return net


def windows_of(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of a text of so many bytes: where reading starts and ends, and where its core does."""
    lo = np.arange(0, length, CORE)
    hi = np.minimum(lo + CORE, length)
    return np.maximum(lo - CONTEXT, 0), np.minimum(hi + CONTEXT, length), lo, hi


class Labeller:
    """Pooled probabilities of documents."""

    def __init__(self, net: Network):
        self.net, self.layers = net, {}
        # The gates and the new state lie in blocks of their own, so that each operation runs over whole memory.  An exponential
        # takes little more than half the time of a tanh: a sigmoid divides by 1 + exp(-x), and tanh(x) is 1 - 2 / (1 + exp(2x)).
        # The signs and the 2 are in the weights.
        scale = np.array([-1, -1, 2], "f4")[:, None, None]
        for d in "fb":
            t, u = (scale * np.stack(np.split(net.p[f"{x}{d}"], 3, 1)) for x in "tu")
            self.layers[d] = tuple(np.ascontiguousarray(x, "f4") for x in (t, u, net.p[f"o{d}"]))
        self.lanes = max(16, min(LANES, 4 * LANES // len(net.languages)))

    def _read(self, d: str, x: np.ndarray, active: np.ndarray) -> np.ndarray:
        """(language, step, lane): what each step adds to the logits; x(step, lane), of which the first ``active`` are read."""
        h = HIDDEN
        (t_z, t_r, t_n), u, o = self.layers[d]
        lanes = x.shape[1]
        state = np.zeros((lanes, h), "f4")
        given, recurrent = np.empty((3, lanes, h), "f4"), np.empty((3, lanes, h), "f4")
        out = np.zeros((o.shape[1], len(x), lanes), "f4")
        with np.errstate(over="ignore"):  # what is divided by infinity is 0, as it should be
            for i, k in enumerate(active.tolist()):
                s, gates, (z, r, n), b, byte = state[:k], given[:2, :k], given[:, :k], recurrent[:, :k], x[i, :k]
                np.take(t_z, byte, 0, z, "clip")  # bytes are in range; this mode isn't buffered
                np.take(t_r, byte, 0, r, "clip")
                np.take(t_n, byte, 0, n, "clip")
                np.matmul(s, u, b)
                gates += b[:2]
                np.exp(gates, gates)
                gates += 1
                e = b[2]
                e /= r
                n += e
                np.exp(n, n)
                n += 1
                np.divide(-2, n, n)
                n += 1
                s -= n
                s /= z
                s += n
                out[:, i, :k] = (s @ o).T
        return out

    def pooled(self, texts: list[str]) -> np.ndarray:
        """(document, language): mean probabilities over all positions; 0 without any."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        sums = np.zeros((len(raw), len(self.net.languages)))
        sizes = np.array([len(b) for b in raw], "i8")
        starts = np.cumsum(sizes) - sizes
        cut = [windows_of(n) for n in sizes.tolist()]
        owner = np.repeat(np.arange(len(raw)), [len(c[0]) for c in cut])
        a, b, lo, hi = (np.concatenate([c[i] for c in cut]) if cut else np.empty(0, "i8") for i in range(4))
        data = np.frombuffer(b"".join(raw), "u1").astype("i8")
        order = np.argsort(a - b, kind="stable")
        for at in range(0, len(order), self.lanes):
            pick = order[at : at + self.lanes]
            length, first = b[pick] - a[pick], starts[owner[pick]] + a[pick]
            step = np.arange(int(length[0]))[:, None]
            active = np.searchsorted(-length, -step[:, 0], "left")
            there = step < length
            forwards = data[np.where(there, first + step, 0)]
            turned = np.where(there, length - 1 - step, 0)
            back = self._read("b", data[first + turned], active).reshape(len(self.net.languages), -1)
            logits = self._read("f", forwards, active)
            logits += back.take(turned * len(pick) + np.arange(len(pick)), 1)
            logits += self.net.p["b"][:, None, None]
            logits -= logits.max(0)
            np.exp(logits, logits)
            place = a[pick] + step
            core = (place >= lo[pick]) & (place < hi[pick])
            logits *= core / logits.sum(0)
            np.add.at(sums, owner[pick], logits.sum(1, dtype="f8").T)
        return sums / np.maximum(sizes, 1)[:, None]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by their id alone; not those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A passage of about SAMPLE_DOCS documents of each language, drawn by a hash of the id."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL").where(~held_out(F.col("id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row for each output of the network
    if not counts:
        return []
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long"))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000))
    place = F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int")
    rows = known.join(sizes, "lang").where(draw * F.col("n") < SAMPLE_DOCS * 1_000_000).select("id", "lang", F.substr("text", place + 1, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (str(r["id"]), r["lang"], r["text"]))]


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole: bool = False) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row; ``whole``: also ``row``, all columns of ``docs``.

    Learns from rows with a language and text that are not held out; predictions see the text
    alone.  Null texts and texts without any letter are ``und`` with score 0, and so is every text
    where nothing could be learned.  Rows with a null id are not held out and not learned from.  Very
    long texts are read whole, in windows; repeated rows are labelled alike.  Without a column
    ``lang_col`` nothing is learned.  Other columns, whatever their names, are at most handed on.
    """
    net = train(sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)) if lang_col in docs.columns else None
    sent = docs.sparkSession.sparkContext.broadcast(net)
    sent_on = docs.columns if whole else [id_col, text_col]
    text_at = sent_on.index(text_col)
    id_at = sent_on.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        labeller = Labeller(net) if net else None

        def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
            row = batch.column(0)
            ids, texts = row.field(id_at), [t or "" for t in row.field(text_at).to_pylist()]
            clear = [i for i, t in enumerate(texts) if labeller is not None and _has_letter(t)]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if clear:
                for i, p in zip(clear, labeller.pooled([texts[i] for i in clear]), strict=True):
                    pred[i], score[i] = net.languages[int(p.argmax())], float(min(1.0, p.max()))
            out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids.to_pylist()]
            names = ["id", "held_out", "lang_pred", "score", *(["row"] if whole else [])]
            return pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *([row] if whole else [])], names)

        for batch in batches:
            sizes = [t.as_py() or 0 for t in pa.compute.binary_length(batch.column(0).field(text_at))]
            lo = size = 0
            for hi, n in enumerate(sizes, 1):
                size += n
                if size > HELD_BYTES or hi == len(sizes):
                    yield judged(batch.slice(lo, hi - lo))
                    lo, size = hi, 0

    own = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    row = F.struct(*sent_on).alias("row")
    kind = T.StructField("row", T.StructType([docs.schema[c] for c in sent_on]))
    return docs.select(row).mapInArrow(run, T.StructType([*own, *([kind] if whole else [])])).withColumnRenamed("id", id_col)
