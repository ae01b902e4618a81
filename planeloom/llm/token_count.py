"""Token counts by a whole-token shortcut: vocabulary strings proven to encode alone as one token are
counted directly, other pre-tokens are merged. Null or empty text counts 0; every row gives one row."""

import functools
import re

import pyarrow as pa

UNIT = re.compile("▁*[^▁\n]+|▁+|\n")  # no vocabulary piece crosses these borders


class Counts(dict):
    """Pre-token to token count; seeded with the proven whole tokens, bounded by limit entries."""

    def __init__(self, path: str, limit: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not odd(i)}
        self.whole = {p: 1 for p in self.score if UNIT.fullmatch(p) and self.merge(p) == 1}
        self.limit = limit
        self.update(self.whole)

    def merge(self, unit: str) -> int:
        import heapq

        s, nxt, prv = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        heap = [(-self.score[a + b], i, a + b) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = nxt[i]
            if not s[i] or j >= len(s) or s[i] + s[j] != piece:
                continue
            s[i], s[j], nxt[i] = piece, "", nxt[j]
            if nxt[i] < len(s):
                prv[nxt[i]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b < len(s) and (p := s[a] + s[b]) in self.score:
                    heapq.heappush(heap, (-self.score[p], a, p))
        return sum(1 if x in self.score else len(x.encode()) for x in s if x)

    def __missing__(self, unit: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.whole)
        self[unit] = n = self.merge(unit)
        return n

    def count(self, text: str) -> int:
        return sum(self[u] for u in UNIT.findall("▁" + text.replace(" ", "▁"))) if text else 0


@functools.cache
def loaded(path: str) -> Counts:
    """One proven table for each worker process, not for each task."""
    return Counts(path)


def token_counts(docs, path: str, max_tokens: int = 4096):
    def run(batches):
        counts = loaded(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > max_tokens for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op2_token_counts": op2_token_counts}
