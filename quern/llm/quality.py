"""Quality classifier by co-training two views.

The text view is the counts of byte pairs (hashed, damped, normalised); the page view is metadata:
language, source, length, and the page's line structure.  Each view trains a logistic regression on
labelled rows.  In each round both views score every unlabelled document; the ``each`` documents that
one view is surest of join the training rows of the *other* one, as far as the view is sure enough:
beyond the margin from which it is right about ``PRECISION`` of the labelled rows held out from training.
Both are then calibrated on the held-out rows.  A document's score is the product of the views'
odds, each to the power of how far its view can be relied on (the log-odds of its held-out
accuracy), calibrated again.  The threshold keeps the stated share of good held-out rows.

What training holds is bounded: at most ``labelled`` labelled rows, chosen by hash, and ``each`` rows a
round and view (some 4 kB of features each).  A round scores all documents in a map and exchanges an
id, a hash and two margins of each, never a text.  The documents are then scored, over their
whole texts, by a map without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, text_hash, unused

#: Labelled rows that training sees at most, rounds, rows that a view labels for the other in a round.
LABELLED, ROUNDS, EACH = 4000, 3, 150
#: Tasks that rank what one view makes of one label, before one task ranks what they found.
PARTS = 64
#: A view labels only beyond a margin where so many held-out rows are right, if there are so many such rows.
PRECISION, ENOUGH = 0.99, 20
#: Below this score a document is rejected; lower where that would reject more than the rest of KEEP_GOOD among good
#: held-out rows, if these are enough to tell.
REJECT, KEEP_GOOD = 0.2, 0.998
#: Hashed byte pairs, further shares, page features; texts well below SHORT bytes count as short.
PAIRS, SHARES, PAGE, SHORT = 1024, 8, 64, 300
SEED = 10


def text_view(data: bytes) -> np.ndarray:
    """Hashed byte-pair counts, damped by the square root, and shares of letter cases, signs and repeats.

    All values shrink towards zero where a text is short, so that a few words decide little.
    """
    v = np.zeros(PAIRS + SHARES, np.float32)
    if len(data) < 2:
        return v
    b = np.frombuffer(data, np.uint8)
    wide = b.astype(np.uint16)
    counts = np.bincount((wide[:-1] * np.uint16(251) + wide[1:] * np.uint16(13)) & np.uint16(PAIRS - 1), minlength=PAIRS)
    n = len(b)
    v[:PAIRS] = np.sqrt(counts / (n + SHORT))
    words = data.split()
    kinds = np.bincount(b, minlength=256)
    m = max(1, len(words))
    v[PAIRS:] = (
        kinds[65:91].sum() / n,
        kinds[48:58].sum() / n,
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / n,
        sum(x == y for x, y in zip(words, words[1:])) / m,
        1 - len(set(words)) / m,
        counts.max() / n,
        float(np.count_nonzero(counts)) / min(n, PAIRS),
        n / m / 20,
    )
    v[PAIRS:] *= 2 * n / (n + SHORT)
    return v


def _slot(name: str, value: str | None, low: int, n: int) -> int:
    data = f"{name}={value}".encode()
    h = 2166136261
    for x in data:
        h = (h ^ x) * 16777619 & 0xFFFFFFFF
    return low + h % n


def page_view(text: str, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Metadata of the page: hashed language and source, length, line structure."""
    v = np.zeros(PAGE, np.float32)
    v[_slot("lang", lang, 16, 16)] = 1
    v[_slot("source", source, 32, 32)] = 1
    lines = text.split("\n")
    sizes = [len(x) for x in lines]
    n = len(text) or 1
    v[0] = np.log1p(n_chars if n_chars is not None else len(text)) / 10
    v[1] = np.log1p(len(lines)) / 5
    v[2] = np.log1p(n / len(lines)) / 6
    v[3] = np.log1p(max(sizes)) / 8
    v[4] = 1 - len(set(lines)) / len(lines)
    v[5] = sum(s == 0 for s in sizes) / len(lines)
    v[6] = text.count(" ") / n * 5
    v[7] = np.log1p(max(sizes) - min(sizes)) / 8
    v[8] = float(v[0] > 0.75)
    return v


@dataclass
class Linear:
    """Logistic regression with calibrated log-odds scale * (w.x + b) + shift."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scale * (x @ self.weights + self.bias) + self.shift


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 400) -> Linear:
    """Accelerated gradient descent on the class-balanced log loss."""
    x = np.ascontiguousarray(x, np.float32)  # the sample is held once; sums are in doubles
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    rate = 4 / (1 + np.max(np.einsum("ij,ij->i", x, x), initial=0))
    for k in range(steps):
        ahead = v
        error = weight * (_sigmoid((x @ ahead[:-1].astype(np.float32)).astype(float) + ahead[-1]) - y)
        step = ahead - rate * (np.append((error.astype(np.float32) @ x).astype(float), error.sum()) + ridge * np.append(ahead[:-1], 0))
        v = step + k / (k + 3) * (step - w)
        w = step
    return Linear(w[:-1], float(w[-1]))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows."""
    z = model.margin(x)
    spread = float(z.std()) or 1.0
    fitted = fit((z / spread)[:, None], y, 1e-2, 200)
    model.scale, model.shift = max(float(fitted.weights[0]) / spread, 1e-6), fitted.bias


@dataclass
class Model:
    """Both views, their weights, and the calibration (scale, shift) of the weighted sum of their log-odds."""

    text: Linear
    page: Linear
    weights: tuple[float, float]
    joint: tuple[float, float]
    threshold: float

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        za, zb = self.text.margin(a), self.page.margin(b)
        return _sigmoid(za), _sigmoid(zb), _sigmoid(self.joint[0] * (self.weights[0] * za + self.weights[1] * zb) + self.joint[1])


def reliability(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds of the accuracy of margins, both classes counting alike; above zero, so that every view counts."""
    accuracy = np.mean([np.mean((z > 0)[y == k] == k) for k in (0, 1)])
    accuracy = np.clip(accuracy, 0.55, 1 - 0.5 / len(y))
    return float(np.log(accuracy / (1 - accuracy)))


def sure_from(z: np.ndarray, y: np.ndarray, label: int) -> float:
    """The margin from which on rows are ``label`` often enough; infinite if there is none."""
    sign = 1 if label else -1
    order = np.argsort(-sign * z, kind="stable")
    right = np.cumsum(y[order] == label) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero((right >= PRECISION) & (np.arange(1, len(y) + 1) >= ENOUGH))
    return float(sign * z[order[fine[-1]]]) if len(fine) else float("inf")


def combine(text: Linear, page: Linear, a: np.ndarray, b: np.ndarray, y: np.ndarray, keep_good: float = KEEP_GOOD) -> Model:
    """Calibrate both views and their product on held-out rows; set the threshold."""
    calibrate(text, a, y)
    calibrate(page, b, y)
    za, zb = text.margin(a), page.margin(b)
    first, second = reliability(za, y), reliability(zb, y)
    weights = (min(1.0, first / second), min(1.0, second / first))
    joint = Linear(np.ones(1))
    calibrate(joint, (weights[0] * za + weights[1] * zb)[:, None], y)
    model = Model(text, page, weights, (joint.scale, joint.shift), REJECT)
    good = np.sort(model.score(a, b)[2][y == 1])
    if (1 - keep_good) * len(good) >= 1:
        model.threshold = float(min(REJECT, good[int((1 - keep_good) * len(good))]))
    return model


def _features(texts: list[str], langs: list, sources: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((len(texts), PAIRS + SHARES), np.float32)
    b = np.zeros((len(texts), PAGE), np.float32)
    for i, (t, lang, source, n) in enumerate(zip(texts, langs, sources, counts, strict=True)):
        t = t or ""
        a[i] = text_view(t.encode())
        b[i] = page_view(t, lang, source, None if n is None or n != n else int(n))
    return a, b


def _held(n: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(training rows, held-out rows): a third is held out, nothing where that leaves a class out."""
    held = np.arange(n) % 3 == 2
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        return np.ones(n, bool), np.ones(n, bool)
    return ~held, held


def _views(docs: DataFrame, wanted: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text view, page view) of the rows with the ``wanted`` (id, text hash), any text where the hash is None; one row an id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    p = unused(docs)
    sample = spark.createDataFrame(wanted, f"{p}id long, {p}h long")
    fits = (F.col("doc_id") == F.col(f"{p}id")) & (F.col(f"{p}h").isNull() | (F.col(f"{p}h") == text_hash("text")))
    rows = docs.join(F.broadcast(sample), fits).select(F.col(f"{p}id").alias("_id"), *_inputs(docs))

    def features(frames):
        for f in frames:
            a, b = _features(list(f["text"]), list(f["lang"]), list(f["source"]), list(f["n_chars"]))
            yield pd.DataFrame({"_id": f["_id"], "a": [x.tobytes() for x in a], "b": [x.tobytes() for x in b]})

    # an id may be repeated any number of times, so one row each is chosen before any is collected
    each = rows.mapInPandas(features, "_id long, a binary, b binary").groupBy("_id").agg(F.min(F.struct("a", "b")).alias("x"))
    got = each.select("_id", "x.a", "x.b").orderBy("_id").toPandas()
    a = np.frombuffer(b"".join(got.a), np.float32).reshape(-1, PAIRS + SHARES)
    b = np.frombuffer(b"".join(got.b), np.float32).reshape(-1, PAGE)
    return got._id.to_numpy(np.int64), a, b


def margins(docs: DataFrame, text: Linear, page: Linear) -> DataFrame:
    """(id, h, a, b): both views' log-odds of every row that has an id, to four places."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("a double, b double")
    def judged(texts: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = _features(texts.tolist(), lang.tolist(), source.tolist(), n_chars.tolist())
        return pd.DataFrame({"a": text.margin(a).round(4), "b": page.margin(b).round(4)})

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text_hash("text").alias("h"), judged(*_inputs(docs)).alias("z"))
    return rows.select("id", "h", "z.a", "z.b")


def surest(scored: DataFrame, known: DataFrame, taken: list[int], low: int, high: int, sure: dict[tuple[str, int], float]) -> list[tuple[str, int, int, int]]:
    """(view, label, id, h): of all ``scored`` documents without a label, the ``low`` bad and ``high`` good ones that each view is surest of.

    ``sure`` is the least margin for each view and label.

    Copies of a text count once, by their smallest id; ties go by hash; ``taken`` hashes are left out.
    """
    spark = scored.sparkSession
    free = scored.join(known.select(F.col("doc_id").alias("id")), "id", "left_anti")
    if taken:
        free = free.join(F.broadcast(spark.createDataFrame([(h,) for h in taken], "h long")), "h", "left_anti")
    once = free.groupBy("h").agg(F.min(F.struct("id", "a", "b")).alias("x")).select("h", "x.*")
    said = [F.struct(F.lit(v).alias("view"), F.lit(n).alias("label"), (F.col(v) * (1 if n else -1)).alias("margin"), F.lit(sure[v, n]).alias("least")) for v in ("a", "b") for n in (0, 1)]
    every = once.select("id", "h", F.explode(F.array(*said)).alias("s")).select("id", "h", "s.*").filter("margin >= least")
    # bounds on the rank, so that partitions send on their best only, and those by way of a number of tasks
    few = every.withColumn("part", F.pmod("h", F.lit(PARTS)))
    for keys in (("view", "label", "part"), ("view", "label")):
        best = Window.partitionBy(*keys).orderBy(F.col("margin").desc(), "h")
        few = few.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(low, high))
    few = few.collect()  # at most 4 * max(low, high) rows
    return sorted((r.view, r.label, r.id, r.h) for r in few if r["rank"] <= (high if r.label else low))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, each: int = EACH) -> Model | None:
    """Co-train on bounded labelled rows and on what each view makes of all others; None where the labels lack a class.

    Labels other than 0 and 1 and null ids are left out; of several labels of one document the larger
    counts; of several rows of one id the one with the least features.
    """
    clean = labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = clean.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(labelled).collect()
    label = {r.doc_id: r.y for r in chosen}
    if len(set(label.values())) < 2:
        return None
    got, a, b = _views(docs, [(i, None) for i in label])
    y = np.array([label[i] for i in got.tolist()])
    fitted, held = _held(len(y), y)
    share = y[fitted].mean()
    more: dict[str, list[tuple[np.ndarray, int]]] = {"a": [], "b": []}
    taken: list[int] = []
    rows = lambda own, x: (np.vstack([x[fitted], *(v[None] for v, _ in own)]), np.append(y[fitted], [n for _, n in own]))
    for k in range(rounds + 1):
        text, page = fit(*rows(more["a"], a)), fit(*rows(more["b"], b))
        if k == rounds:
            break
        limits = {(v, n): sure_from(m.margin(x[held]), y[held], n) for v, m, x in (("a", text, a), ("b", page, b)) for n in (0, 1)}
        sure = surest(margins(docs, text, page), clean, taken, max(1, round(each * (1 - share))), max(1, round(each * share)), limits)
        if not sure:
            break
        found, fa, fb = _views(docs, sorted({(i, h) for _, _, i, h in sure}))
        at = {i: n for n, i in enumerate(found.tolist())}
        for view, n, i, _ in sure:
            # what one view is sure of teaches the other
            more["b" if view == "a" else "a"].append((fb[at[i]] if view == "a" else fa[at[i]], n))
        taken += [h for _, _, _, h in sure]
    return combine(text, page, a[held], b[held], y[held])


def _inputs(docs: DataFrame) -> list:
    """The model's inputs; columns that a table lacks are null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def _judge(docs: DataFrame, model: Model | None):
    kind = "p_text double, p_page double, score double, keep boolean"
    if model is None:
        return F.struct(*(F.lit(None).cast("double").alias(c) for c in ("p_text", "p_page", "score")), F.lit(True).alias("keep"))

    @F.pandas_udf(kind)
    def judged(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        a, b = _features(text.tolist(), lang.tolist(), source.tolist(), n_chars.tolist())
        pa_, pb, s = model.score(a, b)
        return pd.DataFrame({"p_text": pa_, "p_page": pb, "score": s, "keep": s >= model.threshold})

    return judged(*_inputs(docs))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, p_text, p_page, score, keep) of every row of ``docs``.

    Null texts count as empty; repeated rows give a row each; other columns are ignored; without a
    model scores are null and everything is kept.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _judge(docs, model).alias("_q")).select("doc_id", "_q.*")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, unchanged, further columns under whatever names included.

    Null texts count as empty; repeated rows fare alike; without a model, or rows, nothing is rejected.
    """
    bounded_batches(docs.sparkSession)
    p = unused(docs)
    return docs.withColumn(f"{p}judged", _judge(docs, model)).filter(F.col(f"{p}judged")["keep"]).drop(f"{p}judged")
