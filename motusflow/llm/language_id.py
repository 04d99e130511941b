"""Language identification by string kernels: blended-spectrum n-gram presence kernels, Nystroem landmarks, one-versus-rest
kernel ridge regression, scored by batched matrix products.

A text is the set of its character n-grams of 1 to N letters (case folded, other characters as blanks), hashed to
``1 << BITS`` places. The kernel of two texts is the size of the common set over the root of the product of the sizes. The
classifier is fitted on a bounded sample, PER_LANGUAGE labelled documents of each language taken by the hash of doc_id and text, of
which LANDMARKS are landmarks; everything is predicted from whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; documents with a null lang or doc_id are never
learned from, and rows equal in doc_id and text once; without labelled documents all are ``und``; ties go to the first language by name; rows with equal doc_id are
predicted one by one; other columns are not read by ``predicted`` and pass through ``identified``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches
from .encode import lowered
from .pieces import END, LETTER, char_classes, chunks

BITS, N = 14, 3
#: The bound of the training sample, and the landmarks among it, for each language.
PER_LANGUAGE, LANDMARKS = 256, 24
RIDGE = 0.1
#: Score under which the pipeline rejects a document: no machine claims it. A text that shares no n-gram with the landmarks
#: scores 0.5, as there is no intercept; the margin is set on the held-out labelled documents (README).
REJECT = 0.5 + 0.05


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of 0 and 1 for each text over the hashed n-grams, and whether it has a letter. For one chunk of texts."""
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(size) - 1
    letter = char_classes()[cp] == LETTER
    inside = np.ones(len(cp), bool)
    inside[ends] = False
    c = np.where(letter, cp, np.uint32(32))
    row = np.repeat(np.arange(len(texts)), size) << BITS
    out = np.zeros(len(texts) << BITS, np.bool_)
    code, ok = np.zeros(len(cp), np.uint32), np.ones(len(cp), bool)
    for n in range(1, N + 1):
        code, ok = code[: len(cp) - n + 1], ok[: len(cp) - n + 1]
        code = code * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        ok = ok & inside[n - 1 :]
        place = ((code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out[(row[: len(code)] + place)[ok]] = True
    has = np.add.reduceat(letter & inside, ends - size + 1) > 0 if len(texts) else np.zeros(0, bool)
    return out.reshape(len(texts), 1 << BITS), has


def held_out():
    """Whether crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Presence rows, language numbers and languages of the training sample; at most ``per_language`` rows of each."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    keys = known.select("lang", "key").distinct()  # rows equal in doc_id and text count once
    for share in (F.pmod("key", F.lit(64)), F.lit(0)):  # first the lowest of each share, so that no task ranks a language's rows alone
        rank = F.row_number().over(W.partitionBy("lang", share).orderBy("key")).alias("rank")
        keys = keys.select("lang", "key", rank).filter(F.col("rank") <= per_language)
    rows = known.join(F.broadcast(keys), ["lang", "key"])  # per_language keys a language
    rows = rows.groupBy("lang", "rank").agg(F.first("text").alias("text"))

    def run(frames):
        for b in batches(frames):
            x, _ = presence([lowered(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("rank"), pa.array([p.tobytes() for p in np.packbits(x, axis=1)], pa.binary())], names=["lang", "rank", "x"])

    got = sorted((r["lang"], r["rank"], bytes(r["x"])) for r in rows.select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, x binary").collect())
    langs = sorted({g[0] for g in got})
    x = np.array([np.unpackbits(np.frombuffer(g[2], np.uint8)) for g in got], np.float32).reshape(len(got), 1 << BITS)
    return x, np.array([langs.index(g[0]) for g in got], np.int64), langs


class Model:
    """Landmarks (transposed, scaled to norm 1) and the weights of their kernel values for each language."""

    def __init__(self, x: np.ndarray, y: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        pick = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(langs))])
        norm = lambda m: m / np.sqrt(np.maximum(m.sum(1, keepdims=True), 1))
        self.langs = langs
        self.landmarks = np.ascontiguousarray(norm(x[pick]).T)
        values, vectors = np.linalg.eigh((self.landmarks.T @ self.landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        z = norm(x).astype(np.float64) @ self.landmarks @ root
        # languages weigh alike, however many documents each has in the sample
        weight = 1 / np.bincount(y, minlength=len(langs))[y]
        sides = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
        zw = z * weight[:, None]
        self.weights = (root @ np.linalg.solve(zw.T @ z + ridge / len(x) * np.eye(z.shape[1]), zw.T @ sides)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One value a text and language: near 1 if the language's machine claims it, near -1 if not."""
        scale = 1 / np.sqrt(np.maximum(np.count_nonzero(x, axis=1), 1)).astype(np.float32)
        return (x.astype(np.float32) @ self.landmarks) * scale[:, None] @ self.weights


def fitted(docs: DataFrame) -> Model | None:
    x, y, langs = sample(docs)
    return Model(x, y, langs) if langs else None


def _map(docs: DataFrame, model: Model | None, names: list[str], schema: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # PER_LANGUAGE bounds it

    def run(frames):
        m = held.value
        for b in batches(frames, 1_000_000):
            texts = [lowered(t or "") for t in b.column("text").to_pylist()]
            lang, score = [], []
            for _, some in chunks(texts, 500_000):
                for a in range(0, len(some), 512):
                    x, has = presence(some[a : a + 512])
                    if m is None:
                        has[:] = False
                    s = m.scores(x) if m else np.zeros((len(has), 1))
                    best = s.argmax(1)
                    lang += [m.langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
                    score += np.where(has, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0).tolist()
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = model or fitted(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return _map(docs, model, ["doc_id", "held_out"], "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose language is known: neither ``und`` nor scored under ``reject``. Columns are unchanged."""
    model = fitted(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = held.value
        for b in batches(frames, 1_000_000):
            texts = [lowered(t or "") for t in b.column("text").to_pylist()]
            keep: list[bool] = []
            for _, some in chunks(texts, 500_000):
                for a in range(0, len(some), 512):
                    x, has = presence(some[a : a + 512])
                    keep += (has & ((m.scores(x).max(1) + 1) / 2 >= reject)).tolist() if m else [False] * len(has)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
