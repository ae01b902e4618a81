"""Byte-level BPE by backtracking, and decoding by an offset table.

Every pre-token is cut by the longest token that an Aho-Corasick automaton finds at each position; a token stays
only if its pair with the one before is compatible, that is, if merging both spans in rank order would never join
across their border. Where none fits, the encoder steps back, and a bit per position keeps it linear.

Null text counts as empty: no ids. Repeated rows each give a row; extra columns are ignored. The text of an added
special token inside a document becomes its id, as the library does by default.
"""

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the pre-token pattern of byte-level BPE; white space spelled out, as engines differ on control codes.
SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?![^{SPACE}])|{SPACE}+"
#: The same for texts of ASCII only, by the faster engine.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file. The cache has two generations of limit pre-tokens: when the younger is full, the older
    goes; what is used again moves to the younger."""

    def __init__(self, path: str, limit: int = 200_000, longest_cached: int = 64):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        chars = byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # order: rank of a token, bytes first; ids may differ from it. The lists below are by rank.
        order = {vocab[c]: i for i, c in enumerate(chars)} | {vocab[a + b]: 256 + i for i, (a, b) in enumerate(pairs)}
        self.token = [""] * (256 + len(pairs))
        for i, r in order.items():
            self.token[r] = str(i)
        self.split = [(r, r) for r in range(256)] + [(order[vocab[a]], order[vocab[b]]) for a, b in pairs]
        self.joined = {ends: 256 + i for i, ends in enumerate(self.split[256:])}
        raw = {c: bytes([b]) for b, c in enumerate(chars)}
        own = {order[i]: b"".join(raw[c] for c in s) for s, i in vocab.items() if i in order}
        self.size = [len(own.get(r, b"")) for r in range(len(self.split))]
        auto = ahocorasick.Automaton()
        for r, b in own.items():
            auto.add_word(b[::-1].decode("latin-1"), r)
        auto.make_automaton()
        self.auto = auto
        by_bytes = {b: r for r, b in own.items()}
        self.shorter = [next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), None) for b in (own.get(r, b"") for r in range(len(self.split)))]
        parts = [b""] * (1 + max([*order, *self.special.values()]))
        for i, r in order.items():
            parts[i] = own[r]
        for s, i in self.special.items():
            parts[i] = s.encode()
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.cut = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.limit, self.longest_cached = limit, longest_cached

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay apart when their joint text is merged in rank order."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > self.limit:
                self.fits.clear()
            known = self.fits[a, b] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the later of both tokens' merges step by step; a merge across the border that ranks before it wins.
        joined, split, bound = self.joined, self.split, len(self.split) + 1
        while True:
            if (joined.get((a, b)) or bound) < bound:
                return False
            if a > b:
                if a < 256:
                    return True
                bound, a = a, split[a][1]
            else:
                if b < 256:
                    return True
                bound, b = b + 1, split[b][0]

    def ranks(self, piece: bytes) -> list[int]:
        last = len(piece) - 1
        found = list(self.auto.iter(piece[::-1].decode("latin-1")))
        found.reverse()
        longest = dict(found)  # by the end in the reversed piece; of one end the automaton gives the longest first
        size, shorter, fits, compatible = self.size, self.shorter, self.fits, self.compatible
        out, at, open_ = [], 0, bytearray(b"\1") * (last + 2)
        token, before = longest.get(last), None
        while at <= last:
            while token is not None:
                end = at + size[token]
                if open_[end] and (before is None or ((known := fits.get((before, token))) is None and compatible(before, token)) or known):
                    break
                token = shorter[token]
            if token is None:
                open_[at] = 0
                token = out.pop()
                before = out[-1] if out else None
                at -= size[token]
                token = shorter[token]
                continue
            out.append(token)
            before, at = token, end
            token = longest.get(last - at)
        return out

    def _ids(self, piece: str) -> str:
        got = self.older.get(piece) or ",".join([self.token[r] for r in self.ranks(piece.encode())])
        if len(piece) <= self.longest_cached:
            if len(self.cache) >= self.limit:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = got
        return got

    def forget(self) -> None:
        """Empties the caches; what they held is worked out again where it is met."""
        self.cache, self.older, self.fits = {}, {}, {}

    def encode(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        parts = self.at_special.split(text) if self.at_special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(str(self.special[part]))
            elif part:
                for p in (ASCII if part.isascii() else self.cut).findall(part):
                    out.append(self.cache.get(p) or self._ids(p))
        return ",".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offset[ids]
        sizes = self.offset[ids + 1] - starts
        total = int(sizes.sum())
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.blob[at].tobytes()


@functools.cache
def loaded(path: str, limit: int) -> Bpe:
    """One table for each worker process, not for each task."""
    return Bpe(path, limit)


def bpe_documents(docs, path: str, limit: int = 200_000):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; path must be readable on the executors.

    limit: cached pre-tokens of a generation; it changes time and a worker's memory only. A task empties its caches at its end, so
    that idle workers hold the tables alone.
    """

    def run(batches):
        bpe = loaded(path, limit)
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(text or "")
                table = np.fromstring(ids, np.int64, sep=",") if ids else np.zeros(0, np.int64)
                # ids of whole characters decode to valid UTF-8; other bytes become U+FFFD
                back = bpe.decode(table).decode("utf-8", "replace").encode()
                rows.append((doc, len(table), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_bpe": op9_bpe}
