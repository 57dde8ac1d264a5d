"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network; a gated attention unit
weighs the passages, and the weighted mean of their codes is scored. Only the document has a label,
so the attention is learnt from document labels alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import in_arrow, key_and_bytes, query, table
from .labelled import labelled_sample, training_rows, with_verdict

PER_CLASS, PASSAGE, HIDDEN, GATE, EPOCHS = 1500, 100, 24, 12, 250

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, 5, dtype=np.int64)  # other bytes of UTF-8
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 10]] = 0, 1, 2, 3
for _i, _c in enumerate(_MARKS):
    _CLASS[_c] = 6 + _i
_BYTES = 6 + len(_MARKS)
FEATURES = _BYTES + 6


def passage_features(text: bytes, passage: int = PASSAGE) -> np.ndarray:
    """One row per passage of ``passage`` words over the whole text; one zero row for a text without words."""
    words = text.split()
    if not words:
        return np.zeros((1, FEATURES))
    rows = np.zeros((-(-len(words) // passage), FEATURES))
    for k in range(len(rows)):
        part = words[k * passage:(k + 1) * passage]
        n = len(part)
        joined = np.frombuffer(b" ".join(part), dtype=np.uint8)
        rows[k, :_BYTES] = np.sqrt(np.bincount(_CLASS[joined], minlength=_BYTES) / len(joined))
        sizes = np.fromiter(map(len, part), dtype=float, count=n)
        rows[k, _BYTES:] = (len(set(part)) / n, sum(map(bytes.__eq__, part, part[1:])) / n, min(sizes.mean(), 30) / 10,
                            min(sizes.std(), 30) / 10, n / passage, np.mean(joined[1:] == joined[:-1]) if len(joined) > 1 else 0.0)
    return rows


def forward(x: np.ndarray, starts: np.ndarray, m: dict) -> dict:
    """Scores of bags; ``starts`` holds the first passage of each bag."""
    sizes = np.diff(np.r_[starts, len(x)])
    bag = np.repeat(np.arange(len(starts)), sizes)
    x = (x - m["mean"]) / m["std"]
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(z @ m["c"] + m["d"], -30, 30)))}


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, ridge: float = 1e-4) -> dict:
    """Full-batch Adam on the bags; a fixed seed makes the model repeatable."""
    rng = np.random.default_rng(7)
    d = x.shape[1]
    m = {"mean": x.mean(axis=0) if len(x) else np.zeros(d), "std": (x.std(axis=0) if len(x) else np.zeros(d)) + 0.05,
         "W": rng.normal(0, 0.3, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)),
         "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    if not len(y) or y.min() == y.max():
        m["d"] = np.array([2.0 if len(y) and y.max() == 1 else -2.0])
        return m
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    names = ("W", "b", "V", "U", "w", "c", "d")
    first, second = ({n: np.zeros_like(m[n]) for n in names} for _ in range(2))
    for step in range(1, epochs + 1):
        f = forward(x, starts, m)
        out = weight * (f["p"] - y)
        dz = out[:, None] * m["c"]
        per = dz[f["bag"]]
        da = (per * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[f["bag"]])
        dt, ds = de[:, None] * m["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * m["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * per + dt @ m["V"].T + ds @ m["U"].T) * (1 - f["h"] ** 2)
        grads = {"W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds,
                 "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ out, "d": out.sum(keepdims=True)}
        for n in names:
            g = grads[n] + ridge * m[n]
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            m[n] = m[n] - rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    return m


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.3,
                  per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """Columns doc_id, held_out, score, predicted; one row per input row.

    Learnt from at most ``per_class`` labelled texts of each class whose crc32(id) mod ``modulus`` is
    not ``held_out`` (their passage features are what the driver holds); every whole text is scored.
    A null or empty text is one passage of zeros. A null id is scored and not held out. With labels
    of one class only the score is constant. Repeated rows keep one row each; extra columns are not
    read; an empty table gives an empty result.
    """
    def encode(batches):
        for b in batches:
            rows = [passage_features(t) for t in b["text"]]
            yield {"y": b["y"], "n": [len(r) for r in rows], "x": [r.astype(np.float32).tobytes() for r in rows]}

    sample = labelled_sample(docs, labels, label, training_rows(modulus, held_out, id_col), per_class, id_col, text_col)
    seen = in_arrow(sample, encode, "y int, n int, x binary").collect()
    seen.sort(key=lambda r: bytes(r["x"]))  # the order of the rows must not change the model
    x = np.concatenate([np.frombuffer(r["x"], dtype=np.float32) for r in seen]).reshape(-1, FEATURES).astype(float) if seen else np.zeros((0, FEATURES))
    model = train(x, np.array([r["n"] for r in seen], dtype=int), np.array([r["y"] for r in seen], dtype=float))

    def score(batches):
        for b in batches:
            for at in range(0, len(b["id"]), 500):
                rows = [passage_features(t) for t in b["text"][at:at + 500]]
                starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
                yield {"id": b["id"][at:at + 500], "score": forward(np.concatenate(rows), starts, model)["p"]}
    return with_verdict(in_arrow(key_and_bytes(docs, id_col, text_col), score, "id long, score double"), modulus, held_out, threshold)


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
