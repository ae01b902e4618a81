"""Language ID by bit-sliced Bloom filters of letter n-grams.

One table of masks, a bit per language (in as many words as there are 64s of languages): a gram's slots in it, ANDed,
give all languages that (may) hold the gram at once. Fitting counts grams by language over the training rows and keeps
those that are at least half as frequent in a language as in any other, and of its grams at least the part LEAST:
so a language has at most 1 / LEAST grams at any size of the input, which bounds the model. The slots follow from the number of grams. Of a
text's grams, the popcount for each language is corrected by the share of grams that its filter would pass by chance,
fill ** PROBES; the language with the most is predicted and its part of all corrected counts is the score. Ties go to
the first name.

Null texts and texts without letters give "und", score 0; texts whose grams no filter holds give the most frequent
language, score 0. Rows with null lang don't train. No training rows: all "und". Very long texts are read whole, PIECE
characters at a time. Repeated rows each give a row, an empty table none; extra columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import stored

LEAST, SLOTS, PROBES, PIECE, SMALL = 1e-6, 1 << 18, 3, 1 << 20, 10_000
_letters = None


def letters() -> np.ndarray:
    """By code point, 1 where there is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _letters


def grams(text: str):
    """Arrays of hashed grams: three letters of a word with its borders, in lower case; and whether there is a letter."""
    rest = np.zeros(1, np.uint64)  # what comes before the next piece: its grams need two letters of it
    for at in range(0, len(text) + 1, PIECE):
        code = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        code[~letters()[code]] = 0
        code = np.concatenate([rest, code, np.zeros(int(at + PIECE > len(text)), np.uint64)])
        rest = code[-2:]
        a, b, c = code[:-2], code[1:-1], code[2:]
        # a gram has two letters at least, in the middle and at a side
        good = (b > 0) & ((a > 0) | (c > 0))
        yield (a[good] << np.uint64(42)) | (b[good] << np.uint64(21)) | c[good], bool((code > 0).any())


def slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    h = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


class Model:
    def __init__(self, by_language: dict[str, list[int]], fallback: str):
        self.names, self.fallback = sorted(by_language), fallback
        self.size = max(SLOTS, 1 << (16 * max(map(len, by_language.values()), default=0)).bit_length())
        self.table = np.zeros((-(-len(self.names) // 64), self.size), np.uint64)
        for i, name in enumerate(self.names):
            for s in slots(np.array(by_language[name], np.int64).astype(np.uint64), self.size):
                np.bitwise_or.at(self.table[i // 64], s, np.uint64(1 << i % 64))
        self.chance = np.array([self._bits(self.table[i // 64], i).mean() ** PROBES for i in range(len(self.names))])

    @staticmethod
    def _bits(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks >> np.uint64(i % 64)) & np.uint64(1)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of each language the number of keys that its filter passes."""
        at = slots(keys, self.size)
        masks = [np.bitwise_and.reduce([t[s] for s in at]) for t in self.table]
        return np.array([np.count_nonzero(self._bits(masks[i // 64], i)) for i in range(len(self.names))])

    def predict(self, text: str | None) -> tuple[str, float]:
        counts, n, letter = np.zeros(len(self.names)), 0, False
        for keys, some in grams(text or ""):
            letter |= some
            if self.names and len(keys):
                counts += self.counts(keys)
                n += len(keys)
        if not letter or not self.names:
            return "und", 0.0
        true = np.maximum(0, (counts - n * self.chance) / (1 - np.minimum(self.chance, 0.999)))
        if not true.sum():
            return self.fallback, 0.0
        best = int(true.argmax())
        return self.names[best], float(true[best] / true.sum())


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def fit(docs: DataFrame, least: float = LEAST) -> Model:
    """Learns from text and lang of the rows that are not held out. Reads all of them; collects at most 1 / least grams a language."""

    def count(batches):
        sums: dict[str, dict[int, int]] = {}

        def out():
            for lang, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(list(x), pa.int64()), pa.array(list(x.values()), pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = sums.setdefault(lang, {})
                for keys, _ in grams(text):
                    for g, n in zip(*(u.tolist() for u in np.unique(keys, return_counts=True))):
                        x[g] = x.get(g, 0) + n
            if sum(map(len, sums.values())) > 500_000:
                yield from out()
        yield from out()

    train = docs.where("text is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2").select("text", "lang")
    counts = train.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")  # read three times
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    small = totals.count() <= SMALL  # a row for each language
    counts = counts.join(F.broadcast(totals) if small else totals, "lang").withColumn("part", F.col("n") / F.col("total"))
    counts = counts.withColumn("most", F.max("part").over(Window.partitionBy("gram"))).where(F.col("part") * 2 >= F.col("most"))
    by, size = {}, {}
    for lang, gram, n in counts.where(F.col("part") >= least).select("lang", "gram", "n").collect():
        by.setdefault(lang, []).append(gram)
        size[lang] = size.get(lang, 0) + n
    return Model(by, min(by, key=lambda x: (-size[x], x), default="und"))


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only text is an input of a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words

    def run(batches):
        m = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids]), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose language is "und": null texts and texts without letters. A null lang becomes the predicted one.

    A model without languages rejects only rows without letters, and leaves lang. All other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def predicted(text: pa.Array) -> pa.Array:
        m = shared.value
        return pa.array([m.predict(t)[0] if m.names or not any(x for _, x in grams(t or "")) else "" for t in text.to_pylist()], pa.string())

    rows = docs.withColumn("_lang_pred", predicted("text")).where("_lang_pred != 'und'")
    return rows.select(*[F.expr("coalesce(lang, nullif(_lang_pred, ''))").alias("lang") if c == "lang" else c for c in docs.columns])


def op1_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, fit(docs))


QUERIES = {"op1_language_id": op1_language_id}
