"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of up to PASSAGE bytes, cut at white space. Every passage has features of its form
and hashed words; an encoder maps them to HIDDEN units, gated attention (a tanh part times a sigmoid part) weighs
the passages, and the weighted mean is scored. All weights are learned from document labels alone, on at most SAMPLE
labelled rows (those of least hash, and as many of these as have ROOM passages by their sizes; documented bounds on labelled rows, for fitting only). A
row trains with all its passages, and every passage of every text is scored.

Null and empty texts are one empty passage. Rows with null quality don't train; no training rows: score 0.5. Several
labels of a document each count. Repeated rows each give a row; extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

PASSAGE, WORDS, HIDDEN, GATE, SAMPLE, ROOM, STEPS = 600, 32, 24, 16, 6000, 200_000, 400
KINDS = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t\r", "line": b"\n", "stop": b".", "comma": b",", "shout": b"!?", "bar": b"|", "sign": b"#@<>{}[]()=/\\_*&%$:;\"'-+~^`", "high": bytes(range(128, 256))}


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage."""
    raw, rows, at = (text or "").encode(), [], 0
    seen: dict[bytes, int] = {}
    while at < len(raw) or not rows:
        end = min(len(raw), at + PASSAGE)
        if end < len(raw) and (cut := raw.rfind(b" ", at + PASSAGE // 2, end)) > 0:
            end = cut + 1
        p = raw[at:end]
        n = max(1, len(p))
        words = p.split()
        w = max(1, len(words))
        lines = p.split(b"\n")
        old = sum(seen.get(x, 0) > 0 for x in lines if len(x) > 8)
        for x in lines:
            seen[x] = 1
        shares = [(n - len(p.translate(None, k))) / n for k in KINDS.values()]
        form = [len(words) / n * 5, len(set(words)) / w, sum(map(len, words)) / w / 8, max(map(len, words), default=0) / 20, old / len(lines), len(lines) / w, np.log1p(len(p)) / 7, np.log1p(len(raw)) / 10]
        bag = np.bincount([zlib.crc32(x) % WORDS for x in words] or [0], minlength=WORDS) / w
        rows.append(shares + form + bag.tolist())
        at = end
        if not raw:
            break
    return np.array(rows)


class Net:
    def __init__(self, size: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = [r.normal(0, 1 / np.sqrt(a), (a, b)) for a, b in ((size, HIDDEN), (HIDDEN, GATE), (HIDDEN, GATE), (GATE, 1), (HIDDEN, 1))] + [np.zeros(HIDDEN), np.zeros(1)]
        self.mean, self.std = np.zeros(size), np.ones(size)
        self.fitted = False

    def forward(self, x, starts):
        w, v, u, a, c, b, d = self.p
        h = np.tanh((x - self.mean) / self.std @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s @ a)[:, 0]
        sizes = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        alpha = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(alpha[:, None] * h, starts)
        y = 1 / (1 + np.exp(-np.clip((z @ c)[:, 0] + d[0], -30, 30)))
        return h, t, s, alpha, z, y, sizes

    def gradients(self, x, starts, labels) -> list[np.ndarray]:
        """Of the mean logistic loss of the bags, by each of the weights."""
        w, v, u, a, c, b, d = self.p
        h, t, s, alpha, z, y, sizes = self.forward(x, starts)
        gy = (y - labels)[:, None] / len(labels)
        gz = gy @ c.T
        wide = np.repeat(gz, sizes, 0)
        gh = alpha[:, None] * wide
        ga = (wide * h).sum(1)
        ge = (alpha * (ga - np.repeat(np.add.reduceat(alpha * ga, starts), sizes)))[:, None]
        gts = ge @ a.T
        gt, gs = gts * s * (1 - t * t), gts * t * s * (1 - s)
        gh = (gh + gt @ v.T + gs @ u.T) * (1 - h * h)
        return [((x - self.mean) / self.std).T @ gh, h.T @ gt, h.T @ gs, (t * s).T @ ge, z.T @ gy, gh.sum(0), gy.sum(0)]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> "Net":
        if not bags:
            return self
        every = np.concatenate(bags)
        self.mean, self.std, self.fitted = every.mean(0), every.std(0) + 1e-3, True
        r, m1, m2 = np.random.default_rng(11), [0 * p for p in self.p], [0 * p for p in self.p]
        for step in range(1, STEPS + 1):
            at = r.integers(0, len(bags), min(256, len(bags)))
            x, starts = np.concatenate([bags[i] for i in at]), np.cumsum([0] + [len(bags[i]) for i in at[:-1]])
            grads = self.gradients(x, starts, labels[at])
            for i, g in enumerate(grads):
                g = g + 1e-4 * self.p[i]
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                self.p[i] = self.p[i] - 0.01 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray) -> float:
        return float(self.forward(x, np.array([0]))[5][0]) if self.fitted else 0.5


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """Learns from at most sample labelled rows that are not held out; features are made where the texts are."""

    def run(batches):
        for b in batches:
            bags = [passages(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x in bags], pa.binary()), b.column(1).cast(pa.int32())], ["bag", "quality"])

    train = labels.where("quality is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").select("doc_id", "quality")
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").withColumn("h", F.xxhash64("doc_id", "text", "quality"))
    # a passage has half of PASSAGE bytes at least, but for the last; the labelled rows are few, so one window holds their sizes
    sizes = rows.groupBy("h").agg(F.sum(F.expr(f"1 + coalesce(octet_length(text), 0) div {PASSAGE // 2}")).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.orderBy("h"))).where(F.col("upto") <= ROOM).select("h")
    rows = rows.join(F.broadcast(upto), "h").select("text", "quality").mapInArrow(run, "bag binary, quality int").collect()
    rows.sort()
    width = len(KINDS) + 8 + WORDS
    bags = [np.frombuffer(r[0], np.float32).reshape(-1, width).astype(float) for r in rows]
    return Net(width).fit(bags, np.array([r[1] for r in rows], float))


def quality(docs: DataFrame, net: Net, threshold: float = 0.3) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    def run(batches):
        net = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            got = [net.score(passages(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_mil(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op10_quality_mil": op10_quality_mil}
