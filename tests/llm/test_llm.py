"""Small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from planeloom.llm import bpe, components, exact_topk, language_id, license_scan, mixing, ogg, quality_mil, simhash, suffix_dedup, token_count

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefghijkl") for _ in range(R.randint(2, 8))) for _ in range(300)]
PASSAGE = " ".join(R.choice(WORDS) for _ in range(120))


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " ", "...", "a", prose(3), prose(2000), "x" * 1500, prose(90), PASSAGE, prose(50) + PASSAGE + prose(40), "\n" + PASSAGE + " " + prose(30), "é漢字🙂 " * 300, "<|endoftext|> a", "Released under the MIT License."]
TEXTS += [t := prose(200), t, t + " end", t.upper()]
ROWS = [(i, t, ["en", "de", None][i % 3], ["src1", "src2", None][i % 3], -1, -2, -3, -4) for i, t in enumerate(TEXTS)]
ROWS.append(ROWS[10])  # a repeated row
SCHEMA = "doc_id long, text string, lang string, source string, key long, fp long, cuts long, bucket long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.bpe_documents(docs, path).collect())) == sorted(want)
    assert bpe.bpe_documents(empty, path).count() == 0


def test_bpe_random():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, own = Tokenizer.from_file(path), bpe.Bpe(path)
    for _ in range(500):
        s = "".join(R.choice("aé ß\n\t'sthe1２ \x1c\x85🙂漢ँ") for _ in range(60))
        assert own.encode(s) == ",".join(map(str, t.encode(s, add_special_tokens=False).ids))


def test_token_count(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in ROWS]
    assert sorted(map(tuple, token_count.token_counts(docs, path).collect())) == sorted(want)
    assert token_count.token_counts(empty, path).count() == 0


def test_simhash(docs, empty):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t) for i, t, *_ in ROWS}
    parent = {i: i for i in fps}
    for _ in fps:  # smallest reachable, by repeated passes
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    parent[a] = min(parent[a], parent[b])
    assert {i: c for i, (_, c) in got.items()} == parent
    assert all(f % 2**64 == fps[i] for i, (f, _) in got.items())
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_by_the_contract():
    import re

    import xxhash

    for t in TEXTS + ["Ä\u00a0b\x0bC d\x1fe f", "A b c d", "a B c", prose(70_000)]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bands", [6, 7, 8])
def test_close_fingerprints_share_a_cell_and_manhattan_is_a_bound(bands):
    for _ in range(200):
        a = R.getrandbits(64)
        b = a ^ sum(1 << x for x in R.sample(range(64), R.randint(0, 4)))
        both = np.array([a, b], np.uint64)
        at, keys = simhash.cells(both, bands)
        assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist())
        x, y = simhash.segments(both).astype(int)
        assert abs(x - y).sum() <= (a ^ b).bit_count()
    assert [simhash.bands_for(n) for n in (0, 1 << 19, (1 << 19) + 1, 1 << 23, 1 << 27)] == [6, 6, 7, 7, 8]


def test_simhash_cells_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    base = [R.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << x for x in R.sample(range(64), R.randint(0, 4))) for b in base for _ in range(40)})
    table = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(table)).collect()}
    for a in fps:
        for b in fps:
            if a != b and (a ^ b).bit_count() <= 4:
                assert roots[a] == roots[b]


def test_simhash_tasks_grow_and_share_a_component(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "SHARE", 100)
    table = spark.createDataFrame([(i, i + 5) for i in range(1000)], "fp long, first long")
    links = simhash.links(table.coalesce(1))
    used = links.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 50
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        roots = table.where("fp < 900").select(F.col("fp").alias("node"), F.lit(3).cast("long").alias("root"))
        got = simhash.component_ids(table, roots).select("fp", "component_id", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.fp: r.component_id for r in got} == {i: 5 if i < 900 else i + 5 for i in range(1000)} and len(got) == 1000
    assert max(Counter(r.p for r in got).values()) < 450  # one task had all 900


def test_components_deal_a_hub_to_several_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(components, "HUB", 20)
    ends = [(0, i) for i in range(1, 500)] + [(999, i) for i in range(500, 800)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7000, 7000)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(ends, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(500)} | {i: 500 for i in [*range(500, 800), 999]} | {5000 + i: 5000 for i in range(41)} | {7000: 7000}
    rows = spark.createDataFrame([(0, i) for i in range(1, 500)] + [(9, 10)], "a long, b long")
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = components.tied(rows, least, 20).select("a", "b", "m", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.a, r.b, r.m) for r in got) == [(0, i, 1) for i in range(1, 500)] + [(9, 10, 10)]
    assert max(Counter(r.p for r in got).values()) < 200  # one task had all 499


def brute_cuts(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + 400] for r in raws for k in range(len(r) - 399))
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 399):
            if seen[r[k : k + 400]] > 1:
                cover[k : k + 400] = True
        yield r, cover[: len(r)]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 19, 1 << 20), (4000, 700, 50)])
def test_suffix_dedup(spark, docs, empty, monkeypatch, sizes):
    for name, size in zip(("PACK", "PIECE", "BUCKET"), sizes):
        monkeypatch.setattr(suffix_dedup, name, size)
    want = []
    for (i, *_), (raw, cover) in zip(ROWS, brute_cuts([r[1] for r in ROWS])):
        kept = bytes(np.frombuffer(raw, np.uint8)[~cover])
        want.append((i, len(raw), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == sorted(want)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_planted_passages_go_from_400_bytes(spark):
    """Passages of over 50 words in texts that are otherwise unlike: of 400 bytes they go wholly, of 399 they stay; other texts stay whole."""
    long, short = ((prose(120)[: n - 1] + ".") for n in (400, 399))
    assert len(short.split()) > 50
    texts = [f"{prose(80)}{i}{p}{i}{prose(80)}" for i, p in enumerate([long, short, ""] * 3)]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].text) == ((len(t), 400, 1, t.replace(long, "")) if i % 3 == 0 else (len(t), 0, 0, t))


def test_ogg(docs, empty):
    assert ogg.checksum(b"123456789") == 0x89A1897F
    got = ogg.ogg_documents(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        import zlib

        media = ogg.store(payload)
        x = [b - 128 for b in payload]
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r.feature.split(";")[0] == f"seconds={len(payload) / 8000:.6f}"
        assert r.feature.split(";")[2:] == [f"sum={sum(x)}", f"energy={sum(v * v for v in x)}", f"peak={max(map(abs, x))}", f"crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"]
    payload = R.randbytes(130_000)
    times = ogg.read(ogg.store(payload))[3]
    for k, serial in enumerate(ogg.SERIALS):
        sizes = [len(payload[i : i + ogg.CHUNK]) for i in range(k * ogg.CHUNK, len(payload), 2 * ogg.CHUNK)]
        ends = np.cumsum(sizes)
        assert [t for t in times if t[0] == serial] == [(serial, (e - n) / 8000, e / 8000) for n, e in zip(sizes, ends.tolist())]
    for cut in (5, 20, 3000, len(payload)):
        with pytest.raises(ValueError):
            ogg.read(ogg.store(payload)[:cut])
    media = bytearray(ogg.store(R.randbytes(100_000)))
    media[500] ^= 1
    with pytest.raises(ValueError):
        ogg.read(bytes(media))
    assert ogg.ogg_documents(empty).count() == 0


def test_top_k(spark):
    rows = [(i, [R.uniform(-1, 1) for _ in range(19)], 0) for i in range(300)] + [(300, None, 0), (350, [1.0, None], 0), (400, [float("nan")], 0), (7, [0.5] * 19, 0), (450, [0.25], 0)]
    rows += [(i + 500, v, 0) for i, v, _ in rows[:40]]  # ties
    got = sorted(map(tuple, exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()))
    good = [(i, np.floor(256 * np.pad(np.array(v, np.float32).astype(float), (0, 19 - len(v)))).astype(int)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    want = []
    for q, a in good:
        if q % 50 == 0:
            best = sorted((-int(a @ b), i) for i, b in good if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert [(q, n, s) for q, n, _, s in got] == [(q, n, s) for q, n, _, s in sorted(want)]
    assert got == sorted(want)
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_large_components_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "GROUP", 16)
    monkeypatch.setattr(exact_topk, "SEED", 10)
    schema = "vec_id long, embedding array<double>"
    rows = [(50, [1.0]), (1, [9e6]), (2, [-9e6]), (3, [0.5]), (50, [-1.0]), (100, [9.6e6, 1.0]), (4, [9.6e6, 2.0])] + [(i, [R.uniform(-3e6, 3e6) for _ in range(R.randint(1, 6))]) for i in range(5, 80) if i % 50]
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, a) in enumerate(ints):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(ints) if m != n)[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = sorted(map(tuple, exact_topk.top_k(spark.createDataFrame(rows, schema)).collect()))
    assert got == sorted(want) and any(x[3] > 2**62 for x in got)
    two = exact_topk.top_k(spark.createDataFrame([(50, [1.0]), (1, [9e6])], schema)).collect()
    assert [tuple(r) for r in two] == [(50, 1, 1, 589824000000)]


def test_language_id(docs, empty, spark):
    rows = [(i, prose(30) if i % 2 else " ".join(w[::-1].upper() + "zq" for w in prose(30).split()), ["xx", "yy"][i % 2]) for i in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == ["xx", "yy"][r.doc_id % 2] for r in got)
    out = {r.doc_id: r for r in language_id.language_id(docs, language_id.fit(docs)).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.language_id(docs, language_id.fit(empty)).count() == len(ROWS)


def test_language_grams_and_masks():
    """Grams of a text against a plain rule, over cuts into pieces; masks of 70 languages against sets."""
    old, language_id.PIECE = language_id.PIECE, 5
    try:
        for t in ["", "a", "ab", "ab c", "Hello, Wörld 12 xy", prose(40), "é漢字🙂 x" * 5]:
            low = " " + t.lower() + " "
            want = Counter(tuple(x if x.isalpha() else "" for x in low[i : i + 3]) for i in range(len(low) - 2))
            want = Counter({g: n for g, n in want.items() if g[1] and (g[0] or g[2])})
            got = Counter()
            for keys, _ in language_id.grams(t):
                got.update(tuple(chr(c) if (c := k >> s & 0x1FFFFF) else "" for s in (42, 21, 0)) for k in keys.tolist())
            assert got == want
    finally:
        language_id.PIECE = old
    sets = {f"l{i:02}": [R.getrandbits(60) for _ in range(30)] for i in range(70)}
    model = language_id.Model(sets, "l00")
    for name, keys in sets.items():
        counts = dict(zip(model.names, model.counts(np.array(keys, np.uint64))))
        assert counts[name] == 30 and all(n <= 1 for x, n in counts.items() if x != name)


def test_quality_gradients():
    r = np.random.default_rng(1)
    net, x, starts, labels = quality_mil.Net(6), r.normal(size=(9, 6)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = net.forward(x, starts)[5]
        return float(-(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean())

    for p, g in zip(net.p, net.gradients(x, starts, labels)):
        for at in list(np.ndindex(p.shape))[:12]:
            keep = p[at]
            p[at] = keep + 1e-6
            up = loss()
            p[at] = keep - 1e-6
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_quality(docs, empty, spark):
    rows = [(i, prose(60) if i % 2 else prose(20).upper().replace(" ", "!! "), None) for i in range(200)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string, quality int"), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality_mil.quality(d, quality_mil.fit(d, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out)
    net = quality_mil.fit(docs, labels)
    assert quality_mil.quality(docs, net).where("score between 0 and 1").count() == len(ROWS)
    assert quality_mil.quality(docs, quality_mil.fit(empty, labels)).where("score = 0.5").count() == len(ROWS)


def test_license(docs, empty):
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    s = license_scan.Scanner()
    for i, t, *_ in ROWS:
        units = [x for x in (t or "").split("\n") if x]
        units += [t] if len(units) > 1 else []
        best = None
        for u in units:
            for name, texts in license_scan.TEMPLATES.items():
                for x in texts:
                    a, b = license_scan.bigrams(u), license_scan.bigrams(x)
                    dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                    if dice >= s.threshold and (best is None or (-dice, name) < best):
                        best = (-dice, name)
        assert (got[i].license, got[i].dice) == ((best[1], -best[0]) if best else (None, None))
    assert got[14].license == "MIT" and license_scan.license_scan(empty).count() == 0


def test_mixing(docs, empty, spark):
    rows = mixing.mixed(docs, epochs=3, parts=(2, 1)).collect()
    assert all(r.mix_tokens > 0 and 0 <= r.mix_epoch < 3 for r in rows)
    total = sum((len((t or "").encode()) + 3) // 4 for _, t, *_ in ROWS)
    assert 0 < sum(r.mix_tokens for r in rows) <= 2 * total
    assert mixing.mixed(empty).count() == 0


def shared(budget, children):
    """Budgets of (weight, cap) by the rule itself: raise all unfilled children by weight until the budget or the caps are used."""
    got, open_ = [0.0] * len(children), {i for i, (w, c) in enumerate(children) if w > 0 and c > 0}
    while open_ and budget > 1e-9:
        total = sum(children[i][0] for i in open_)
        step = min([budget / total] + [(children[i][1] - got[i]) / children[i][0] for i in open_])
        for i in open_:
            got[i] += step * children[i][0]
        budget -= step * total
        open_ = {i for i in open_ if children[i][1] - got[i] > 1e-6}
    return got


def test_mixing_target_weights(spark, docs, empty):
    supply = {("x", "en", "a"): 400, ("x", "en", "b"): 40, ("x", "de", "c"): 300, ("y", "en", "d"): 50, ("y", "de", "e"): 900, ("z", "en", "f"): 500}
    given = {("x",): 3, ("y",): 1, ("x", "en"): 1, ("x", "de"): 1, ("x", "en", "a"): 1, ("x", "en", "b"): 4, ("y", "de", "e"): 2}
    rows = [(i, "abcd" * n, l, s, d) for i, (d, l, s, n) in enumerate((d, l, s, 2) for (d, l, s), n in supply.items() for _ in range(n // 2))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, field string")
    weights = spark.createDataFrame([((*k, None, None)[:3] + (float(w) / 2,)) for k, w in given.items()] + [("x", "en", "b", float("0")), ("x", "en", "b", None), ("x", "en", "b", -3.0)], "mix_domain string, mix_lang string, mix_source string, weight double")

    def budgets(node, budget):
        if len(node) == 3:
            return {node: budget}
        kids = sorted({k[: len(node) + 1] for k in supply if k[: len(node)] == node})
        named = any(k[: len(node)] == node and len(k) == len(node) + 1 for k in given)
        total = sum(n for k, n in supply.items() if k[: len(node)] == node)
        own = lambda k: sum(n for s, n in supply.items() if s[: len(k)] == k)
        taken = lambda k: all(not any(g[:-1] == k[:j] and len(g) == j + 1 for g in given) or k[: j + 1] in given for j in range(3))
        cap = lambda k: 2 * sum(n for s, n in supply.items() if s[: len(k)] == k and taken(s))
        weight = lambda k: given.get(k, 0) if named else 9 * len(kids) * own(k) + total
        out = {}
        for k, b in zip(kids, shared(budget, [(weight(k), cap(k)) for k in kids])):
            out |= budgets(k, b)
        return out

    want = budgets((), sum(supply.values()))
    got = dict.fromkeys(supply, 0)
    for r in mixing.mixed(table, epochs=2, weights=weights, domain="field").collect():
        assert r.mix_epoch < 2
        got[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_tokens
    assert want["z", "en", "f"] == 0 and want["x", "en", "b"] == 80  # not named; full
    for k, n in got.items():
        assert want[k] - 5 < n <= want[k] + 1e-6, (k, n, want)
    assert mixing.mixed(empty, weights=weights).count() == 0
    none = weights.limit(0)
    assert mixing.mixed(docs, weights=none).count() == mixing.mixed(docs).count()


def test_pipeline_stages_keep_columns(spark, docs, empty):
    import corpus_pipeline

    for table in (docs, empty):
        at = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, None)
            assert at.columns == docs.columns
        assert at.where("text is null").count() == 0
    texts = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, None).collect()}
    for (i, t, *_), (raw, cover) in zip(ROWS, brute_cuts([r[1] for r in ROWS])):
        want = bytes(np.frombuffer(raw, np.uint8)[~cover]).decode("utf-8", "ignore")
        assert (texts[i] or "") == want


def test_license_notices_in_longer_texts():
    s = license_scan.Scanner()
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n'
    assert s.scan(prose(40) + "\n" + apache + prose(90))[:3] == ("Apache-2.0", 1.0, 1)
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    assert s.scan(mit)[0] == "MIT"
    assert s.scan(prose(70) + " " + mit + " " + prose(70))[:3] == ("MIT", 1.0, 1)
    isc = "# Permission to use, copy, modify, and/or distribute this\n# software for any purpose with or without fee is hereby\n# granted, provided that the above copyright notice and this\n# permission notice appear in all copies.\n"
    assert s.scan(prose(60) + "\n" + isc + prose(60))[:2] == ("ISC", 1.0)
    assert s.scan("The data set is free. Released under the MIT License. Have fun with it, all of you.")[:3] == ("MIT", 1.0, 1)
    assert s.scan(prose(30) + " " + license_scan.TEMPLATES["GPL-3.0"][2] + prose(30))[0] == "GPL-3.0"
    assert s.scan(mit + "\n" + prose(200) + " released under the MIT License. " + prose(9) + " Licensed under CC BY-NC 4.0.")[2:] == (3, ["CC-BY-NC-4.0", "MIT"])


def test_license_windows_against_brute_force():
    templates = {"A": ["a b c d e f g"], "B": ["a b a b a c", "d"], "C": ["f g a b b b c d e"]}
    s = license_scan.Scanner(templates)
    for _ in range(300):
        words = [R.choice("abcdefg") for _ in range(R.randint(0, 40))]
        want = []
        for name, texts in templates.items():
            for x in map(license_scan.words_of, texts):
                for i in range(len(words) - len(x) + 1):
                    a, b = license_scan.bigrams(words[i : i + len(x)]), license_scan.bigrams(x)
                    want.append((-2 * len(a & b) / (len(a) + len(b)), name))
        want = min((x for x in want if -x[0] >= s.threshold), default=None)
        got = min(((-d, name) for d, name, *_ in s.windows(words)), default=None)
        assert got == want


@pytest.mark.parametrize("chunk, volume", [(1024, 1 << 21), (2, 1 << 21), (1024, 300)])
def test_pipeline_near_copies(spark, monkeypatch, chunk, volume):
    import corpus_pipeline
    from planeloom.llm import near_copies

    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "VOLUME", volume)

    texts = []
    for n in (20, 60, 120, 400):
        for _ in range(12):
            words = prose(n).split()
            texts.append(" ".join(words))
            for _ in range(4):  # each copy is of the one before it
                for _ in range(R.randint(0, max(1, n // 40))):
                    words[R.randrange(n)] = R.choice(WORDS)
                texts.append(" ".join(words))
    sets = [set(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    first = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((first[i], first[j]))
                first = [x if f == y else f for f in first]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, None).collect()}
    assert kept == set(first) and len(kept) < len(texts) - 48
    assert near_copies.joined([near_copies.shingles(t) for t in texts]) == first


def test_null_and_shared_ids(spark):
    import corpus_pipeline

    a, b, c = prose(150), prose(150), prose(200)
    rows = [(None, a), (None, b), (0, b + " end"), (5, c), (5, prose(80)), (5, prose(90)), (None, c + " z"), (7, prose(60)), (7, prose(60))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(tuple(r) for r in corpus_pipeline.near_dedup(spark, table, None).collect())
    assert kept == Counter(r for i, r in enumerate(rows) if i not in (1, 6))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(table).collect())
    assert got == Counter((i, len(raw), int(cover.sum())) for (i, _), (raw, cover) in zip(rows, brute_cuts([t for _, t in rows])))
    assert any(i is None and n for i, _, n in got)
    nulls = spark.createDataFrame([(None, prose(20), "en", "s") for _ in range(40)], "doc_id long, text string, lang string, source string")
    total = sum((len(r.text) + 3) // 4 for r in nulls.collect())
    taken = sum(r.mix_tokens for r in mixing.mixed(nulls, parts=(1, 2)).collect())
    assert total // 2 - 60 < taken <= total // 2


def test_pipeline_hands_over_parquet(spark, monkeypatch):
    import corpus_pipeline

    read = []
    stage = lambda spark, docs, sf_dir: read.append(docs.inputFiles()) or docs.where("doc_id % 2 = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"stage{i}", stage) for i in range(3)])
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.doc_id % 2 == 0 for r in rows)
    folder = spark.conf.get("spark.checkpoint.dir")
    for name, files in zip(("stage0", "stage1"), read[1:]):
        assert files and all(f"{folder}/" in f and f"/{name}-" in f and f.endswith(".parquet") for f in files)
