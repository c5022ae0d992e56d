import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from karstline.llm import hpylm as h


def corpus(n=300):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(600)]
    texts = [None, "", " \t\n", "ÉCOLE école Ab aB\x0bc\x0cd e"]
    for _ in range(n):
        if rng.random() < 0.2 and len(texts) > 10:
            texts.append(rng.choice(texts[4:]))
        else:
            texts.append(" ".join(rng.choice(words) if rng.random() < 0.9 else f"new{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))))
    return texts


def base(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = lambda t: [w for w in (t or "").translate(lower).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] + ["END "]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(x), sum(w in c for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, t in rows for x in [tokens(t)]]


@pytest.mark.parametrize("bucket_bytes", [10**9, 4000])
def test_base_columns_and_gain(spark, docs, bucket_bytes):
    rows = [*enumerate(corpus()), (None, "null id here"), (3, "again"), (3, "again")]
    got = h.score(docs(rows).selectExpr("*", "1 AS id", "2 AS part", "3 AS blob"), bucket_bytes=bucket_bytes).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 6))
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(found, sorted(base(rows), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    for held in (True, False):
        part = [r for r in got if r.held_out is held]
        assert sum(r.score for r in part) > sum(r.base_score for r in part)
    assert all(r.score <= 0 and math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-6) for r in got)


def packed_buckets(spark, docs, texts, n):
    frame = docs(texts).selectExpr("doc_id AS id", "text", "false AS out")
    hot = h._hot_words(frame, n)
    packed = h._parts(frame, n, hot).repartition(n, "bucket").sortWithinPartitions("bucket", "part").where("bucket >= 0").cache()
    return packed, hot


def test_probabilities_sum_to_one_over_buckets_and_hot_words(spark, docs):
    packed, hot = packed_buckets(spark, docs, corpus(120), 3)
    assert len(hot)
    totals, answers = h._count(packed, hot, 2)
    for i, samples in ((1, 1), (2, 3)):
        totals, answers = h._sample(packed, totals, answers, 2, i, 2, samples)
    left, right = (f.toPandas() for f in (packed, answers.where(f"kind in ({h.ANSWER}, {h.STATE})")))
    read = [h._read_bucket(pa.Table.from_pandas(left[left.bucket == k]), pa.Table.from_pandas(right[right.bucket == k])) for k in sorted(set(left.bucket))]
    assert len(read) == 3 and not all(state.shared.all() for _, state, _, _ in read)
    for s in range(3):
        root, hot_seen, own, back, seen = 0.0, set(), Counter(), {}, {}
        for b, state, customers, elsewhere in read:
            t, t0 = state.tables[s], state.root[s].copy()
            _, known = b.known(totals)
            c0 = b.of_words(t)
            at, values = b.hot(totals.hot[s])
            if len(at):
                c0[at], t0[at] = np.array(values).T
            assert (t <= b.count).all() and (t[b.count > 0] >= 1).all() and (t0 <= c0).all()
            p = totals.root(c0, t0, known, s)
            for i, w in enumerate(b.words.view(np.int64).tolist()):
                if i not in at.tolist() or w not in hot_seen:
                    root += p[i]
                    hot_seen.add(w)
            tables = elsewhere[s] + b.of_contexts(t)
            for u, x, c, whole in zip(b.contexts.tolist(), b.of_contexts(b.count - totals.discount * t).tolist(), customers.tolist(), tables.tolist(), strict=True):
                own[u] += x
                assert back.setdefault(u, (c, whole)) == (c, whole)
                seen[u] = seen.get(u, 0) + 1
        assert max(seen.values()) == 3
        whole = h.ROOT_STRENGTH + totals.root_customers[s]
        root += (h.ROOT_STRENGTH + totals.root_discount * totals.root_tables[s]) * totals.unknown / whole
        assert math.isclose(root, 1, rel_tol=1e-9)
        assert math.isclose(totals.root_customers[s], sum(t for _, t in back.values()))
        for u, (c, t) in back.items():
            assert math.isclose((own[u] + h.STRENGTH + totals.discount * t) / (h.STRENGTH + c), 1, rel_tol=1e-9)


def exact_tables(customers, room, first, later, whole, d):
    """Chances of each number of tables, from all seatings one by one."""
    states = {(1,): room * first / whole}
    for _ in range(1, customers):
        nxt = Counter()
        for sizes, p in states.items():
            j = len(sizes)
            nxt[tuple(sorted((*sizes, 1)))] += p * (room + d * j) * (later + j) / (whole + j)
            for k, n in enumerate(sizes):
                nxt[tuple(sorted((*sizes[:k], n + 1, *sizes[k + 1 :])))] += p * (n - d)
        states = nxt
    out = Counter()
    for sizes, p in states.items():
        out[len(sizes)] += p
    return {t: p / sum(out.values()) for t, p in out.items()}


def test_tables_are_drawn_from_their_exact_distribution():
    rng = np.random.default_rng(0)
    for c, room, first, later, whole, d in ((2, 1.5, 0.2, 0.6, 9.0, 0.4), (3, 1.0, 2.0, 2.0, 5.0, 0.7), (6, 4.0, 0.01, 0.3, 3.0, 0.2), (14, 2.0, 0.5, 0.5, 4.0, 0.5)):
        n = 40_000
        got = Counter(h.Seating(d, rng).draw(np.full(n, float(c)), np.full(n, room), np.full(n, later), whole).tolist())
        for t, p in exact_tables(c, room, first, later, whole, d).items():
            assert abs(got[t] / n - p) < 0.01
    many = h.Seating(0.5, rng).draw(np.array([5000.0, 3.0, 1.0]), np.array([2.0, 1e-12, 1.0]), np.array([1.0, 1e-12, 1.0]), 1.0, 0)
    assert 1 <= many[0] <= 5000 and many[1:].tolist() == [1, 1]


def test_samples_match_the_exact_posterior_of_a_tiny_corpus():
    """All seatings of a few dishes, weighed by the model's joint probability, against long runs of the sampler."""
    tokens = [(0, 0)] * 3 + [(0, 1)] * 2 + [(1, 0)] * 2 + [(1, 1)] + [(2, 0)] * 2  # (word, context)
    words, contexts = np.array([5, 9, 12], np.uint64) << np.uint64(40), np.array([3, 8], np.uint64) << np.uint64(30)
    rows = sorted(tokens)
    blob = h._pack(words[[w for w, _ in rows]], contexts[[u for _, u in rows]], np.zeros(len(rows), np.uint16), np.ones(len(rows), bool))
    bucket = h.Bucket(0, [(0, blob)])
    d, d0, unknown = 0.5, 0.4, 0.1
    totals = h.Totals(float(len(tokens)), 3.0, d, d0, unknown)
    counts = Counter(tokens)
    dishes = sorted(counts)
    log_s, log_s0 = h.stirling(d, 10), h.stirling(d0, 20)
    rising = lambda a, step, n: sum(math.log(a + step * i) for i in range(n))
    exact, mass = np.zeros(len(dishes)), 0.0
    mean_root = 0.0
    for ts in itertools.product(*(range(1, counts[x] + 1) for x in dishes)):
        log = sum(log_s[counts[x], t] for x, t in zip(dishes, ts, strict=True))
        for u in (0, 1):
            log += rising(h.STRENGTH, d, sum(t for x, t in zip(dishes, ts, strict=True) if x[1] == u))
        c0 = [sum(t for x, t in zip(dishes, ts, strict=True) if x[0] == w) for w in range(3)]
        for t0 in itertools.product(*(range(1, c + 1) for c in c0)):
            p = math.exp(log + sum(log_s0[c, t] for c, t in zip(c0, t0, strict=True)) + rising(h.ROOT_STRENGTH, d0, sum(t0)) - rising(h.ROOT_STRENGTH, 1, sum(c0)) + sum(t0) * math.log((1 - unknown) / 3))
            mass += p
            exact += p * np.array(ts)
            mean_root += p * sum(t0)
    exact, mean_root = exact / mass, mean_root / mass
    state, got, roots, n = h.start(bucket), np.zeros(len(dishes)), 0.0, 6000
    nowhere = [np.zeros(2)]
    for i in range(n):
        # with one bucket the totals of the last state are known at once
        totals.root_customers, totals.root_tables, totals.hot = [state.tables[-1].sum()], [state.root[-1].sum()], [{}]
        state = h.sweeps(bucket, totals, h.State(state.tables[-1:], state.root[-1:], state.shared), bucket.customers, nowhere, i, 0, 1)
        got += state.tables[0]
        roots += state.root[0].sum()
    assert np.abs(got / n - exact).max() < 0.08
    assert abs(roots / n - mean_root) < 0.15


def test_kept_numbers_come_back():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        for n in (0, 1, 1000):
            values = rng.integers(0, np.iinfo(kind).max, n, kind, endpoint=True)
            got, rest = h.unsqueeze(memoryview(h.squeeze(values) + b"rest"), kind)
            assert (got == values).all() and bytes(rest) == b"rest"
    ids = (None, 2**62 + 1, -(2**62) - 1)
    got = h._read_documents(h._documents(ids, (True, False, True), np.array([1, 2, 3])))
    assert [i if ok else None for i, ok in zip(got[0].tolist(), got[1], strict=True)] == list(ids) and got[2].tolist() == [True, False, True] and got[3].tolist() == [1, 2, 3]


def test_texts_that_occur_twice_are_told_apart(spark, docs):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(300)]
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    perplexity = lambda rows: {r.doc_id: r.perplexity for r in h.score(docs(rows), bucket_bytes=20_000).collect()}
    alone = perplexity(list(zip(free, texts, strict=False)))
    more = perplexity([*zip(free, texts, strict=False), *zip(free[300:], texts[:30], strict=False)])
    ratio = [more[i] / alone[i] for i in free[:300]]
    assert max(ratio[:30]) < min(1, *ratio[30:])


def test_more_sweeps_and_buckets_leave_the_held_out_score(spark, docs):
    frame = docs(corpus(400))
    total = lambda **o: sum(r.score for r in h.score(frame, **o).where("held_out").collect())
    usual = total()
    for options in ({"passes": 4}, {"burn_in": 30}, {"bucket_bytes": 3000}, {"seed": 7}):
        assert abs(total(**options) / usual - 1) < 0.01


def test_empty_table_and_nothing_to_learn_from(spark, docs):
    assert h.score(docs([])).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = h.score(docs([(held, "a b")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isclose(row.base_score, 0, abs_tol=1e-12)
