"""The corpus operators against brute force: odd tables, hard cases, and the pipeline's stages."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from pricelore.llm import decontam, mixing, packs, registry, secrets, sharding, simhash, substring, topk, toxicity
from pricelore.llm.common import pack, ship, unpack

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, many=10**6):
    return [f"w{rnd.randrange(many)}" for _ in range(n)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_blocks_of_columns():
    rnd = np.random.default_rng(3)
    columns = [rnd.integers(0, 1 << 63, 50, dtype=np.uint64), rnd.integers(-9, 9, 50), rnd.integers(0, 256, (50, 7), dtype=np.uint8)]
    for a, b in zip(columns, unpack(pack(columns), ("u8", "i8", 7))):
        assert (a == b).all()


# Mixing


def test_mixing_keeps_columns_of_any_name(spark):
    rows = [(i, "a b " * (i % 5), f"s{i % 2}", i, i, i, i, i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rest int, epochs int, copies int, edge int, `a.b` int, bucket int, size int")
    got = mixing.mix(df).collect()
    assert len(got) == 40 and all(r["rest"] == r["epochs"] == r["edge"] == r["a.b"] == r["bucket"] == r["doc_id"] for r in got)
    assert all(r["size"] == 2 * (r["doc_id"] % 5) and r["taken"] == r["copies"] * r["size"] for r in got)


def test_mixing_against_a_plain_version(spark):
    rnd = random.Random(9)
    docs = [(i if i % 11 else None, " ".join(words(rnd, rnd.randint(0, 30))), rnd.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for i in range(300)]
    docs += [(7, "same text", "a")] * 3
    labels = {i: rnd.randint(0, 1) for i in range(0, 300, 3)}
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = mixing.mix(registry.with_quality(df, known), weight=registry.F.col("__weight"))
    got = sorted((str(r.doc_id), r.text, str(r.source), r.copies) for r in got.collect())
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    want = []
    for s in order:
        mine = []
        for i, t, of in docs:
            if of == s:
                name = "" if i is None else str(i)
                unit = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                q = {1: 1.0, 0: 0.5}.get(labels.get(i), 0.75)
                mine.append((-np.log(unit) / q, i is not None, i or 0, hashlib.md5(t.encode()).hexdigest(), str(i), t))
        epochs, before = int(target[s] // sizes[s]), 0
        for *_, i, t in sorted(mine):
            n = len(t.split())
            want.append((i, t, str(s), epochs + (before + n / 2 < target[s] - epochs * sizes[s])))
            before += n
    assert got == sorted(want)


# Secrets


def test_base_spans_by_a_plain_reading():
    rnd = random.Random(4)
    parts = ["password", "Passwd", "api_key", "apikey", "TOKEN", "secret", '"', "'", " ", ":", "=", "abcd1234", "x", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "\n", ".", "/"]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def run(t, at, chars):
        end = at
        while end < len(t) and t[end] in chars:
            end += 1
        return end

    letters = "abcdefghijklmnopqrstuvwxyz"
    value = letters + letters.upper() + "0123456789+/_.=-"

    def plain(t):
        out, at = [], 0
        while at < len(t):
            name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low(t[at:]).startswith(n)), None)
            p = at + len(name) if name else at
            if name:
                p += t[p : p + 1] in ('"', "'") and p < len(t)
                p = run(t, p, " ")
            if name and t[p : p + 1] in (":", "=") and p < len(t):
                # An optional quote, then the longest value.
                p = run(t, p + 1, " ")
                p += t[p : p + 1] in ('"', "'") and p < len(t)
                end = run(t, p, value)
                if end > p:
                    if end - p >= 8:
                        out.append((at, 0, end))
                    at = end
                    continue
            at += 1
        for kind, chars, head, least in ((1, letters.upper() + "0123456789", "AKIA", 16), (2, "0123456789abcdef", "", 32)):
            at = 0
            while at < len(t):
                end = run(t, at + len(head), chars) if t.startswith(head, at) else at
                if end > at + len(head):
                    if end - at >= least:
                        out.append((at, kind, end))
                    at = end
                else:
                    at += 1
        return sorted(out)

    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert secrets.base_spans(t) == plain(t), t


def test_random_strings_found_and_names_left():
    encode = secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    rnd = random.Random(8)
    found = lambda run: bool(secrets.random_spans(f"see {run} there", encode))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n, least in ((16, 95), (20, 97), (32, 99), (64, 100)):
        assert sum(found("".join(rnd.choice(letters) for _ in range(n))) for _ in range(100)) >= least
    plain = ["get", "user", "account", "settings", "value", "index", "name", "data", "file", "path", "time", "config", "server", "client", "request"]
    camel = lambda n: "".join(w.title() for w in rnd.choices(plain, k=n))
    assert sum(found(camel(4)) + found("_".join(rnd.choices(plain, k=4)) + "_2024") for _ in range(100)) == 0


def test_long_runs_take_linear_time(spark):
    encode = secrets.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    rnd = random.Random(1)
    began = time.time()
    for text in ("a" + "-" * 100_000 + "b1c2dxyzuvw9k", "Ab-" * 50_000 + "9" * 7, "aB" * 50_000, "".join(rnd.choice("abcXYZ019") for _ in range(100_000)), "token=" * 20_000):
        secrets.random_spans(text, encode)
        secrets.base_spans(text)
    assert time.time() - began < 10
    rows = spark.createDataFrame([(1, "x" * 200_000 + " token=abcdefgh1"), (1, ""), (1, ""), (None, None)], "doc_id long, text string")
    got = secrets.find_secrets(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(r.n_assign for r in got.collect()) == [0, 0, 0, 1] and got.limit(0).count() == 0


# Toxicity


def plain_logit(net, gates, window):
    p, h = net.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    states = np.zeros((len(window), 2 * h))
    for side, u in enumerate((p["u0"], p["u1"])):
        state = np.zeros(h)
        for t in range(len(window)) if side == 0 else reversed(range(len(window))):
            x = gates[window[t], side * 3 * h : (side + 1) * 3 * h]
            z = sigmoid(x[:h] + state @ u[:, :h])
            r = sigmoid(x[h : 2 * h] + state @ u[:, h : 2 * h])
            new = np.tanh(x[2 * h :] + r * (state @ u[:, 2 * h :]))
            state = (1 - z) * new + z * state
            states[t, side * h : (side + 1) * h] = state
    real = [t for t in range(len(window)) if t == 0 or window[t] != 0]
    weight = np.exp([states[t] @ p["att"] for t in real])
    pooled = sum(w * states[t] for w, t in zip(weight / weight.sum(), real))
    return float(pooled @ p["out"] + p["bias"][0])


def test_network_step_by_step_and_by_numeric_gradient():
    rng = np.random.default_rng(2)
    net = toxicity.Network(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("word", "gram")}
    gates = rng.standard_normal((9, 6 * toxicity.HIDDEN))
    windows = np.array([[1, 2, 3, 4, 5], [6, 7, 8, 0, 0], [0, 0, 0, 0, 0]])
    assert np.allclose(net.run(gates, windows), [plain_logit(net, gates, w) for w in windows], atol=1e-4)
    _, memory = net.run(gates, windows, keep=True)
    d = np.array([0.3, -0.2, 0.1])
    grads, dgates = net.backward(gates, windows, memory, d)
    loss = lambda: sum(x * plain_logit(net, gates, w) for x, w in zip(d, windows))
    for array, grad in [(gates, dgates), *((net.p[k], g) for k, g in grads.items())]:
        for at in rng.integers(0, array.size, 6):
            place = np.unravel_index(at, array.shape)
            was = array[place]
            array[place] = was + 1e-5
            up = loss()
            array[place] = was - 1e-5
            down = loss()
            array[place] = was
            assert abs((up - down) / 2e-5 - grad[place]) < 1e-3


def test_windows_cover_every_word():
    for n in (0, 1, 11, 12, 13, 20, 21, 500):
        got = toxicity.windows_of(np.arange(1, n + 1))
        assert set(range(1, n + 1)) <= set(got.ravel().tolist())


def test_toxicity_of_odd_tables(spark):
    net = toxicity.train(["good day", "vile slur"] * 40, [0, 1] * 40)
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "word " * 30_000), (None, "x")], "doc_id long, text string")
    got = toxicity.score_toxicity(df, net).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(df.limit(0), net).count() == 0
    docs = spark.createDataFrame([(i % 50, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    texts, y = toxicity.sample(docs, labels)
    learn = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(texts) == sorted(min(f"text {j}" for j in range(i, 200, 50)) for i in learn) and sum(y) == sum(i % 2 for i in learn)


# Decontamination


def test_decontamination_in_several_passes(spark, monkeypatch):
    rnd = random.Random(15)
    items = {i: " ".join(words(rnd, rnd.choice((4, 12, 20)), 40)) for i in range(24)}
    docs = [(i, " ".join(words(rnd, 30, 40)) + " " + items[rnd.randrange(24)] + " x", i) for i in range(30)] + [(30, None, 1), (30, "", 1), (31, "clean Text.", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = sorted(map(str, decontam.contamination(df, bench, ("doc_id",)).collect()))
    monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", 2)
    assert sorted(map(str, decontam.contamination(df, bench, ("doc_id",), block_words=60).collect())) == want
    kept = {r.doc_id: r.text for r in decontam.decontaminate(df, bench).collect()}
    for i, t, _ in docs[:30]:
        split = decontam.words_of(t)
        hit = set()
        for item in items.values():
            w = decontam.words_of(item)
            n = min(10, len(w))
            grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            for a in range(len(split) - n + 1):
                if tuple(split[a : a + n]) in grams:
                    hit.update(range(a, a + n))
        left = [w for a, w in enumerate(split) if a not in hit]
        assert kept.get(i, "").encode().split() == (left if len(hit) < 0.5 * len(split) else [])
    assert kept[31] == "clean Text." and decontam.decontaminate(df.limit(0), bench).count() == 0


# Top-k


def test_top_k_with_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.integers(-2, 3, 8).astype(float).tolist()) for i in range(400)]
    rows += [(400, [1.0, 2.0]), (401, []), (402, [0.0] * 12 + [5.0]), (7, rows[7][1]), (100, [3.0] * 8), (None, [1.0] * 8), (403, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 100 = 0"), scale=1, block_rows=90).orderBy("query_id", "rank").collect()]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b)))
    want = []
    for query in (0, 100, 200, 300, 400):
        vector = min(v for i, v in rows if i == query)
        scores = sorted((-dot(vector, v), i) for i, v in rows if i is not None and i not in (query, 403))[:10]
        want += [(query, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == want


# Repeated passages


def test_chains_against_quadratic_chaining():
    rnd = random.Random(12)
    for _ in range(300):
        k, gap, cost = 4, 30, 0.0931
        pairs = set()
        for _ in range(rnd.randint(1, 5)):
            x, y = rnd.randrange(200), rnd.randrange(200)
            for _ in range(rnd.randint(1, 12)):
                x, y = x + rnd.randint(0, 25), y + rnd.randint(0, 25)
                pairs.add((x, y))
        pairs = sorted(pairs)
        best = []
        for i, (x, y) in enumerate(pairs):
            # Of equal values the later match is followed, as they stand in floating point.
            value, j = max(((best[j] + cost * (p + q), j) for j, (p, q) in enumerate(pairs[:i]) if p < x and q < y and x - p <= gap + k and y - q <= gap + k), default=(-1e18, -1))
            score = value - cost * (x + y)
            best.append(score + min(k, x - pairs[j][0], y - pairs[j][1]) if score > 0 else float(k))
        chains = substring.chains_of([x for x, _ in pairs], [y for _, y in pairs], k, cost, gap)
        assert sorted(c for chain in chains for c in chain) == list(range(len(pairs)))
        first = chains[0]
        score = float(k)
        for a, b in zip(first, first[1:]):
            (p, q), (x, y) = pairs[a], pairs[b]
            assert p < x and q < y and x - p <= gap + k and y - q <= gap + k
            score += min(k, x - p, y - q) - cost * (x - p + y - q)
        assert abs(score - max(best)) < 1e-6


def test_fenwick_against_all_values():
    rnd = random.Random(13)
    for _ in range(200):
        size, entered = rnd.randint(1, 20), []
        tree = substring.Fenwick(size)
        for x in range(40):
            low, high, bound = rnd.randint(1, size), rnd.randint(0, size), max(0, x - 10)
            want = max((v for r, at, v in entered if low <= r <= high and at >= bound), default=(-1e18, -1))
            assert tree.best(low, high, bound) == want
            rank, value = rnd.randint(1, size), (rnd.random(), x)
            tree.enter(rank, x, value)
            entered.append((rank, x, value))


@pytest.mark.parametrize("most", [0, 2, 32])
def test_chains_by_diagonals_places_or_tree(monkeypatch, most):
    monkeypatch.setattr(substring, "MOST_DIAGONALS", most)
    rnd = random.Random(31)
    for _ in range(60):
        k, gap, cost = 4, 30, 0.0931
        pairs = sorted({(x + d, y + d) for x, y in ((rnd.randrange(90), rnd.randrange(60)) for _ in range(6)) for d in range(0, 40, rnd.randint(1, 5))} | {(x, 7) for x in range(0, 60, 3)})
        best = []
        for i, (x, y) in enumerate(pairs):
            value, j = max(((best[j] + cost * (p + q), j) for j, (p, q) in enumerate(pairs[:i]) if p < x and q < y and x - p <= gap + k and y - q <= gap + k), default=(-1e18, -1))
            score = value - cost * (x + y)
            best.append(score + min(k, x - pairs[j][0], y - pairs[j][1]) if score > 0 else float(k))
        first = [pairs[c] for c in substring.chains_of([x for x, _ in pairs], [y for _, y in pairs], k, cost, gap)[0]]
        score = k + sum(min(k, x - p, y - q) - cost * (x - p + y - q) for (p, q), (x, y) in zip(first, first[1:]))
        assert abs(score - max(best)) < 1e-6


def test_chains_of_repeated_lines_need_no_tree(monkeypatch):
    entered = []
    monkeypatch.setattr(substring.Fenwick, "enter", lambda *a: entered.append(a))
    line = [(x, x) for x in range(0, 60, 3)]
    pairs = sorted((x + 60 * n, y) for n in range(50) for x, y in line)
    chains = substring.chains_of([x for x, _ in pairs], [y for _, y in pairs], 4)
    assert [[pairs[c] for c in chain] for chain in sorted(chains)] == [[(x + 60 * n, y) for x, y in line] for n in range(50)]
    run = [(x, 24 * (x // 70)) for x in range(2000)]  # a word again and again
    substring.chains_of([x for x, _ in run], [y for _, y in run], 4)
    assert not entered


def test_seeds_of_texts_together():
    rnd = random.Random(32)
    texts = [" ".join(words(rnd, n)) for n in (0, 2, 3, 4, 27, 28, 60, 300)] + ["", " \t ", "A b-c\n" * 40, "x" * 5000 + " y z" * 60]
    for some in (texts, texts[:-1]):  # with a word that is too long to be hashed with others, and without
        w, counts = substring.hashes_within([t.encode().translate(decontam.FOLD) for t in some])
        assert counts.tolist() == [len(decontam.words_of(t)) for t in some]
        text, *found = substring.seeds_within(w, counts, 4, 4, 24)
        for i, t in enumerate(some):
            assert all((a[text == i] == b).all() and len(a[text == i]) == len(b) for a, b in zip(found, substring.seeds_of(decontam.words_of(t), 4, 4, 24)))


def test_links_of_equal_stretches_are_thinned():
    run = [(2, 1, x, x - 5) for x in range(10, 21)] + [(2, 1, x, x + 40) for x in range(12, 14)] + [(3, 1, 9, 9)]
    columns = [np.array(c) for c in zip(*run)]
    kept = [run[i] for i in substring._thinned(*columns, 4).tolist()]
    assert kept == [(2, 1, x, x - 5) for x in (10, 14, 18, 20)] + [(2, 1, 12, 52), (2, 1, 13, 53), (3, 1, 9, 9)]
    assert not len(substring._thinned(*(c[:0] for c in columns), 4))


def test_hashes_of_words_stand_alone():
    rnd = random.Random(18)
    ws = [f"w{rnd.randrange(9000)}".encode() for _ in range(50_000)] + [b"x" * 300_000, b"y" * 300_000]
    h = substring.hashes_of(ws).tolist()
    assert len(set(h)) == len(set(ws)) and all(substring.hashes_of([b"a", w, b"b"])[1] == v for w, v in list(zip(ws, h))[::997])
    assert substring.hashes_of(ws[-2:]).tolist() == h[-2:] and len(substring.hashes_of([b"one"])) == 1


def test_alignments_go_on_to_the_ends_of_long_passages(spark, monkeypatch):
    # Only one seed links the two texts across tasks: all others are nearer to a third text's.
    monkeypatch.setattr(substring, "REACH", 8)
    rnd = random.Random(14)
    a = words(rnd, 900)
    rows = [(1, " ".join(words(rnd, 40) + a + words(rnd, 40))), (2, " ".join(words(rnd, 10) + a + words(rnd, 5)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = [tuple(r) for r in substring.repeated_passages(df, every=400, stretch=400).collect()]
    assert got == [(2, 1, 10, 910, 40, 940, 900)]


def test_passages_within_a_text_and_of_repeated_rows(spark):
    rnd = random.Random(16)
    own = lambda n: words(rnd, n)
    p, q = own(60), own(70)
    rows = [(1, own(20) + p + own(90) + p + own(20)), (2, own(10) + q + own(10)), (2, own(10) + q + own(10)), (3, own(5) + q), (3, own(5) + q)]
    rows = [(i, " ".join(w)) for i, w in rows]
    df = spark.createDataFrame([*rows, rows[1], rows[1]], "doc_id long, text string")
    for parts in (1, 5):
        got = {(r.doc_id, r.other_id) for r in substring.repeated_passages(df.repartition(parts)).collect()}
        assert {(1, 1)} <= got <= {(1, 1), (2, 2), (3, 2), (3, 3)} and got & {(3, 2)}


def test_tasks_of_seeds_and_links_hold_little():
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(19)
    texts = [" ".join(words(rnd, 250)) for _ in range(1500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 500)), pa.array(texts[a : a + 500])], names=["id", "text"]) for a in range(0, 1500, 500)]
    tracemalloc.start()
    try:
        out = list(substring._seed_blocks(iter(batches), 4, 4, 24, 50, 0.8, 1))
        seeds = tracemalloc.get_traced_memory()[1]
        n = sum(len(unpack(b, substring._SEED_TYPES)[0]) for r in out for b in r.column(2).to_pylist())
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        list(substring._link_blocks(iter(out * 4), 1))
        links = tracemalloc.get_traced_memory()[1] - held
    finally:
        tracemalloc.stop()
    assert n > 80_000 and seeds < 340 * n and links < 320 * 4 * n  # words as a list, and blocks in several copies, take 470 and 400 bytes a seed


def share_found(spark, length, changed, seed):
    rnd = random.Random(seed)
    rows, n = [], 60
    for i in range(n):
        passage = words(rnd, length)
        other = [f"n{rnd.randrange(10**9)}" if rnd.random() < changed else w for w in passage]
        other[0], other[-1] = passage[0], passage[-1]
        rows += [(2 * i, " ".join(words(rnd, 40) + passage + words(rnd, 40))), (2 * i + 1, " ".join(words(rnd, 40) + other + words(rnd, 40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.other_id) for r in substring.repeated_passages(df).collect()}
    assert got <= {(2 * i + 1, 2 * i) for i in range(n)}
    return len(got) / n


def test_recall_of_fuzzy_passages(spark):
    assert share_found(spark, 60, 0.08, 1) >= 0.95 and share_found(spark, 100, 0.12, 2) >= 0.95


# Near duplicates


def jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates_hold_the_exact_similarity(spark):
    rnd = random.Random(31)
    texts = []
    for _ in range(14):
        base = words(rnd, 250, 4000)
        texts.append(" ".join(base))
        for changes in (2, 4, 5, 6, 7, 9, 14):
            other = list(base)
            for at in rnd.sample(range(3, 247), changes):
                other[at] = f"new{rnd.random()}"
            texts.append(" ".join(other))
    texts += ["", None, "short text", "short text", "Short TEXT"]
    n = len(texts)
    group = list(range(n))
    close = [[jaccard(a or "", b or "") >= 0.8 for b in texts] for a in texts]
    for _ in range(n):
        group = [min(group[j] for j in range(n) if close[i][j]) for i in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, shingle_words=5, similarity=0.8).collect()}
    assert all(group[got[i]] == group[i] for i in range(n))  # no wrong link
    assert sum(got[i] == group[i] for i in range(n)) >= 0.97 * n


def test_near_duplicates_check_all_pairs_of_a_list(spark):
    # Every text has one partner that is similar enough, among many that are near it by their sketches alone.
    rnd = random.Random(9)
    rows = []
    for group in range(3):
        base = words(rnd, 300)
        for n, start in enumerate(2 * rnd.sample(range(100, 140), 40), 1):  # a step apart is 0.799
            rows.append((80 * group + n, " ".join(base[:start] + words(rnd, 28) + base[start + 28 :])))
    texts = dict(rows)
    label = {i: i for i in texts}
    sets = {i: {tuple(t.split()[n : n + 5]) for n in range(len(t.split()) - 4)} for i, t in texts.items()}
    for a in texts:
        for b in range((a - 1) // 80 * 80 + 1, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=5, similarity=0.8).collect()}
    assert got == label and len(set(label.values())) == 120


def classes_of(sets, similarity=0.8):
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = sorted((label[a], label[b]))
                label = {i: x if v == y else v for i, v in label.items()}
    return label


def test_near_duplicates_pass_on_no_pairs_of_a_large_group(spark, monkeypatch):
    # All texts are near each other by their sketches, and most pairs are not similar.
    rnd = random.Random(10)
    base, n = words(rnd, 300), 150
    texts = {}
    for i in range(n):
        own = list(base)
        for at in rnd.sample(range(4, 296), 5):
            own[at] = f"new{rnd.random()}"
        texts[i] = " ".join(own)
    rows, real = [], simhash.stored

    def counted(df, name):
        out = real(df, name)
        if name in ("candidates", "links"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle_words=5, similarity=0.8).collect()}
    assert got == classes_of({i: {tuple(t.split()[k : k + 5]) for k in range(296)} for i, t in texts.items()})
    assert len(set(got.values())) > n // 2 and sum(rows) < simhash.BANDS * n


def test_joins_of_a_list_against_all_pairs(monkeypatch):
    from zstandard import ZstdCompressor

    rnd = random.Random(12)
    for block in (10**6, 900, 1):
        monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
        monkeypatch.setattr(simhash, "LOOKED_UP", 500)
        for _ in range(8):
            texts = ["", "one", "one two"]
            for _ in range(4):
                base = words(rnd, rnd.randint(5, 60), 40 if rnd.random() < 0.3 else 10**6)
                texts += [" ".join(w if rnd.random() > 0.05 else f"n{rnd.randrange(9)}" for w in base[: rnd.randint(len(base) // 2, len(base))]) for _ in range(12)]
            sets = {i: set(simhash.shingle_hashes(t, 2).tolist()) for i, t in enumerate(dict.fromkeys(texts))}
            texts = list(dict.fromkeys(texts))
            label = np.array([rnd.choice([i, i, 0]) for i in range(len(texts))])
            before = label.copy()
            found = simhash._joins_of_list([ZstdCompressor().compress(t.encode()) for t in texts], label, 2, 0.8)
            assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in found) and len(found) == len(set(before)) - len(set(label))
            assert all(label[a] == label[b] for a in sets for b in sets if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))


def test_fingerprints_by_a_plain_reading():
    import xxhash

    rnd = random.Random(33)
    for t in ("", "One", "one TWO", *(" ".join(words(rnd, rnd.randint(3, 60), 9)) + " É\tx" for _ in range(40))):
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        for c in "\t\n\x0b\x0c\r":
            ws = ws.replace(c, " ")
        ws = [w for w in ws.split(" ") if w]
        shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# Sharding and packs


def test_sharding_of_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 9 else None, "old", i) for i in range(200)], "doc_id long, shard string, slot int")
    names = [f"s{i}" for i in range(5)]
    placed = sharding.place(df, names, slots=101)
    assert sorted(placed.columns) == ["doc_id", "shard", "slot"] and {r.shard for r in placed.collect()} <= set(names)
    sharding.write_shards(df, str(tmp_path / "out"), names, slots=101, rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and sorted(map(str, back.select("doc_id", "shard").collect())) == sorted(map(str, placed.select("doc_id", "shard").collect()))


def test_dictionary_from_repeated_ids(spark):
    df = spark.createDataFrame([(i % 60, f"text number {i} " * 30) for i in range(600)] + [(None, "x")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packs.train_dictionary(df, path, sample_rows=50) == packs.train_dictionary(df.repartition(5), path, sample_rows=50)


# The pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(41)
    path = str(tmp_path_factory.mktemp("tables"))
    common = [f"c{i}" for i in range(300)]
    text = lambda n=60: [rnd.choice(common) + str(rnd.randrange(40)) for _ in range(n)]
    rows, labels, toxic = [], [], set()
    for i in range(900):
        bad = i % 3 == 0
        t = text()
        if bad:
            for at in rnd.sample(range(60), 9):
                t[at] = rnd.choice(["vilea", "vileb", "vilec", "viled"])
            toxic.add(i)
        rows.append((i, " ".join(t)))
        labels.append((i, i % 2, int(bad)))
    clean = [i for i in range(900) if i not in toxic]
    near = {}
    for n, i in enumerate(clean[:40]):
        t = rows[i][1].split()
        if n % 2:
            t[5] = "other"
        near[1000 + n] = i
        rows.append((1000 + n, " ".join(t)))
    items = [(f"item{n}", " ".join(f"q{n}x{j}" for j in range(20))) for n in range(6)]
    rows += [(2000 + n, " ".join([*text(40), *items[n][1].split(), *text(40)])) for n in range(6)] + [(2100, items[0][1]), (2200, None), (2201, "")]
    docs = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, toxic, near


def test_pipeline_by_stages(spark, folder):
    path, toxic, near = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    kept = {r.doc_id for r in stages["toxicity"](spark, docs, path).collect()}
    assert len(toxic & kept) <= 0.1 * len(toxic) and len((set(whole) - toxic) - kept) <= 0.02 * len(whole)
    single = {r.doc_id: r.text for r in stages["near_duplicates"](spark, docs, path).collect()}
    assert set(whole) - set(single) == set(near) | {2201}
    cleaned = {r.doc_id: r for r in stages["decontamination"](spark, docs, path).collect()}
    assert set(whole) - set(cleaned) == {2100} and "q1x0" not in cleaned[2001].text and cleaned[2001].n_chars == len(cleaned[2001].text)
    assert all(cleaned[i].text == whole[i] for i in range(900))
    mixed = [r.doc_id for r in stages["mixing"](spark, docs, path).collect()]
    plan = {r.doc_id: r.copies for r in mixing.mix(registry.with_quality(docs, spark.read.parquet(f"{path}/labels.parquet")), weight=registry.F.col("__weight")).collect()}
    assert all(mixed.count(i) == n for i, n in plan.items()) and len(mixed) == sum(plan.values())
    shards = {r.doc_id: r.shard for r in stages["sharding"](spark, docs, path).collect()}
    table = sharding.lookup_table(registry.SHARDS)
    assert all(s == registry.SHARDS[table[int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) % len(table)]] for i, s in shards.items())


def test_pipeline_is_its_stages_in_turn(spark, folder, tmp_path):
    path, _, near = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "shard").collect()))
    got = corpus_pipeline.run(spark, path)
    assert rows(got) == rows(docs) and not {r.doc_id for r in got.collect()} & set(near)
