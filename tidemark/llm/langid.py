"""Language of texts by a bidirectional gated recurrent network over bytes, written and trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import id_text, sent_if_bounded

#: Bytes of a window; each window is one sequence and every byte of a text lies in one window.
WINDOW = 96
#: Documents of each language in the training sample (the documented bound), and windows taken of each at most, evenly
#: over its whole text.
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
HIDDEN, STEPS, BATCH, RATE = 8, 500, 96, 0.02
#: Windows which go through the network at a time.
BLOCK = 4_096
#: Texts with letters a task turns into Python values at a time; their rows leave it together.
TEXTS = 256
UNDETERMINED = "und"
PAD = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.clip(x, -30, 30, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights of both directions and of the labels; ``table`` has a row of gate inputs for each byte value."""

    labels: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in ("f", "b"):
            w[f"table_{d}"] = rng.normal(0, 0.3, (257, 3 * hidden))
            w[f"gates_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
            w[f"state_{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        w["out"] = rng.normal(0, 0.3, (2 * hidden, len(labels)))
        w["bias"] = np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in w.items()})

    def states(self, data: np.ndarray, direction: str, trace: list | None = None) -> np.ndarray:
        """Hidden states (time, window, unit) of one direction; ``data`` is (time, window) of byte values."""
        table, gates, state = (self.weights[f"{k}_{direction}"] for k in ("table", "gates", "state"))
        n = state.shape[0]
        h = np.zeros((data.shape[1], n), np.float32)
        out = np.empty((*data.shape, n), np.float32)
        order = range(len(data)) if direction == "f" else range(len(data) - 1, -1, -1)
        for t in order:
            x = table.take(data[t], 0, mode="clip")
            zr = x[:, :2 * n]
            zr += h @ gates
            _sigmoid(zr)
            z, r = zr[:, :n], zr[:, n:]
            c = x[:, 2 * n:]
            c += (r * h) @ state
            np.tanh(c, out=c)
            if trace is not None:
                trace.append((t, h, z, r, c))
            h = h + z * (c - h)
            out[t] = h
        return out

    def scores(self, data: np.ndarray) -> np.ndarray:
        """Label probabilities (time, window, label) of every position."""
        w = self.weights
        n = w["state_f"].shape[0]
        logits = self.states(data, "f") @ w["out"][:n]
        logits += self.states(data, "b") @ w["out"][n:]
        logits += w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all real positions and its gradients, by backpropagation through time."""
        w, n = self.weights, self.weights["state_f"].shape[0]
        traces = {"f": [], "b": []}
        h = np.concatenate([self.states(data, d, traces[d]) for d in ("f", "b")], axis=2)
        logits = h @ w["out"] + w["bias"]
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        real = (data != PAD).astype(np.float32)
        total = max(1.0, float(real.sum()))
        windows = np.arange(data.shape[1])
        loss = float(-(np.log(p[:, windows, target] + 1e-9) * real).sum() / total)
        p[:, windows, target] -= 1
        p *= (real / total)[:, :, None]
        g = {"out": np.einsum("twh,twl->hl", h, p), "bias": p.sum(axis=(0, 1))}
        back = p @ w["out"].T
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            table, gates, state = (np.zeros_like(w[f"{k}_{d}"]) for k in ("table", "gates", "state"))
            dh = np.zeros((data.shape[1], n), np.float32)
            for t, before, z, r, c in reversed(traces[d]):
                dh = dh + part[t]
                dc = dh * z * (1 - c * c)
                dz = dh * (c - before) * z * (1 - z)
                drh = dc @ w[f"state_{d}"].T
                dr = drh * before * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                state += (r * before).T @ dc
                gates += before.T @ dzr
                np.add.at(table, data[t], np.concatenate([dzr, dc], axis=1))
                dh = dh * (1 - z) + drh * r + dzr @ w[f"gates_{d}"].T
            g |= {f"table_{d}": table, f"gates_{d}": gates, f"state_{d}": state}
        return loss, g


def windows(text: str | bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW values; the last row is padded."""
    raw = np.frombuffer(text if isinstance(text, bytes) else text.encode("utf-8", "replace"), np.uint8)
    out = np.full((max(1, -(-len(raw) // WINDOW)), WINDOW), PAD, np.int16)
    out.reshape(-1)[:len(raw)] = raw
    return out


def train(rows: list[tuple[str | list[bytes], str]], seed: int = 7) -> Network | None:
    """Fit by Adam on windows of (text or chosen windows, label); None without rows."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    parts: dict[int, list[np.ndarray]] = {i: [] for i in range(len(labels))}
    for text, label in rows:
        w = windows(text) if isinstance(text, str) else np.concatenate([windows(x) for x in text])
        pick = rng.permutation(len(w))[:SAMPLE_WINDOWS]
        parts[labels.index(label)].append(w[pick])
    pools = [np.concatenate(parts[i]) for i in range(len(labels))]
    net = Network.fresh(labels, HIDDEN, seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, STEPS + 1):
        target = rng.integers(len(labels), size=BATCH)  # languages alike, whatever their share
        data = np.stack([pools[i][rng.integers(len(pools[i]))] for i in target]).T
        _, g = net.gradients(data, target)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = RATE * (1 - 0.9 * step / STEPS) * min(1.0, 1.0 / (norm + 1e-9))
        for k, v in g.items():
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.weights[k] -= (rate * (first[k] / (1 - 0.9**step))
                               / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[str]) -> np.ndarray:
    """Mean label probabilities over all positions of each text; windows of all texts share the blocks."""
    sums = np.zeros((len(texts), len(net.labels)))
    lengths = np.zeros(len(texts))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        data = np.concatenate([w for _, w in held])
        owner = np.concatenate([np.full(len(w), i) for i, w in held])
        p = net.scores(data.T)
        real = (data.T != PAD)
        np.add.at(sums, owner, (p * real[:, :, None]).sum(axis=0))
        np.add.at(lengths, owner, real.sum(axis=0))
        held, size = [], 0

    for i, text in enumerate(texts):
        w = windows(text)
        for at in range(0, len(w), BLOCK):
            held.append((i, w[at:at + BLOCK]))
            size += len(held[-1][1])
            if size >= BLOCK:
                flush()
    flush()
    return sums / np.maximum(lengths, 1)[:, None]


def held_out(key: str) -> Column:
    """Whether a document is kept from training."""
    return F.crc32(id_text(key).cast("binary")) % 5 == 0


def sample(docs: DataFrame, key: str, text: str, label: str) -> list[tuple[list[bytes], str]]:
    """Windows of at most SAMPLE_DOCS labelled texts of each language, lowest digest of the key first, none held out.

    Ids and labels alone decide the sample; only the chosen texts are read in the second pass.
    """
    ids = docs.select(F.col(key).alias("_k"), F.col(label).alias("_l")).filter(
        F.col("_l").isNotNull() & F.col("_k").isNotNull() & ~held_out("_k"))
    digest = F.md5(id_text("_k"))
    part = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    # a digest bound by the language's count leaves about four times the sample, so no task ranks a whole language
    counts = ids.groupBy("_l").agg(F.count("*").alias("_c"))
    few = ids.join(sent_if_bounded(counts), "_l").filter(part < 4.0 * SAMPLE_DOCS / F.col("_c"))
    ranked = few.select("_l", "_k", F.row_number().over(
        Window.partitionBy("_l").orderBy(digest, "_k")).alias("_n")).filter(F.col("_n") <= SAMPLE_DOCS)
    picked = F.broadcast(ranked.select("_k").distinct())
    raw = F.encode("_t", "UTF-8")
    count = F.ceil(F.octet_length("_t") / F.lit(WINDOW))
    taken = F.least(count, F.lit(SAMPLE_WINDOWS))
    chosen = F.transform(F.sequence(F.lit(0).cast("bigint"), taken - 1), lambda j: F.substring(
        raw, (F.floor(j * count / taken) * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(label).alias("_l")).filter(
        F.col("_l").isNotNull() & F.col("_t").rlike(r"\p{L}")).join(picked, "_k").select(chosen.alias("_w"), "_l").collect()
    return sorted(([bytes(w) for w in r["_w"]], r["_l"]) for r in rows)


def predict(docs: DataFrame, text: str, net: Network | None, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns, and the predicted language and its score under the given (new) names, of every row.

    A text that is null or has no letter, or any text without a trained network, is ``und`` with score 0. Whole texts
    are labelled, byte by byte; repeated rows and null keys stay; an empty table gives no rows.
    """
    schema = StructType([*docs.schema.fields]).add(label, "string").add(score, "double")
    names = docs.columns
    at = names.index(text)

    def labelled(rows: pa.RecordBatch, use: list[int], texts: list[str]) -> pa.RecordBatch:
        lang, sure = [UNDETERMINED] * rows.num_rows, np.zeros(rows.num_rows)
        if use:
            for i, row in zip(use, pooled(net, texts)):
                best = int(row.argmax())
                lang[i], sure[i] = net.labels[best], min(1.0, float(row[best]))
        columns = [*rows.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, label, score])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, use, texts = 0, [], []
            for i, value in enumerate(batch.column(at)):
                text = value.as_py() if net else None
                if text and any(map(str.isalpha, text)):
                    use.append(i - low)
                    texts.append(text)
                if len(use) == TEXTS or i + 1 == batch.num_rows:
                    yield labelled(batch.slice(low, i + 1 - low), use, texts)
                    low, use, texts = i + 1, [], []

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, key: str, text: str, known: str, label: str, score: str) -> DataFrame:
    """Train on the bounded sample of rows with a ``known`` language, then predict every row."""
    return predict(docs, text, train(sample(docs, key, text, known)), label, score)
