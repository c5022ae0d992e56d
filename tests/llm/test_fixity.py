import hashlib

from karstline.llm import fixity as f


def records(spark, rows):
    return spark.createDataFrame(rows, "file long, key long, record binary")


def sample(n=200, per_file=70):
    return [(i // per_file, i, f"record {i} {'x' * (i % 13)}".encode()) for i in range(n)]


def found(frame):
    return sorted((r.file, r.node, r.key) for r in frame.collect())


def plain_root(rows, fanout):
    nodes = {}
    for file in sorted({r[0] for r in rows}):
        at, level = 0, []
        for _, _, rec in sorted(r for r in rows if r[0] == file):
            level.append((at, at + len(rec), hashlib.sha256(rec).hexdigest()))
            at += len(rec)
        while len(level) > 1:
            groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            level = [(g[0][0], g[-1][1], hashlib.sha256("\n".join(f"{a}:{b}:{h}" for a, b, h in g).encode()).hexdigest()) for g in groups]
        nodes[file] = level[0]
    return nodes


def test_roots_match_a_plain_tree(spark):
    rows = sample(140, 70)
    _, roots = f.file_trees(records(spark, rows), fanout=4)
    got = {r.file: (r.from_offset, r.to_offset, r.hash) for r in roots.collect()}
    assert got == plain_root(rows, 4)
    top = hashlib.sha256("\n".join(f"{a}:{b}:{h}" for _, (a, b, h) in sorted(got.items())).encode()).hexdigest()
    assert f.archive_root(roots, fanout=4) == top


def test_locates_each_damaged_record(spark):
    rows = sample()
    for fanout in (2, 16):
        assert found(f.audit(records(spark, rows), records(spark, list(reversed(rows))), fanout=fanout)) == []
        hurt = [(a, k, r[:-1] + b"!" if k in (0, 69, 131) else r) for a, k, r in rows]
        assert found(f.audit(records(spark, rows), records(spark, hurt), fanout=fanout)) == [(0, 0, 0), (0, 69, 69), (1, 61, 131)]


def test_lost_records_files_and_empty_replicas(spark):
    rows = sample()
    lost = [r for r in rows if r[1] != 68]
    assert found(f.audit(records(spark, rows), records(spark, lost))) == [(0, 68, 68), (0, 69, 69)]
    no_file = [r for r in rows if r[0] != 1]
    assert len(found(f.audit(records(spark, rows), records(spark, no_file)))) == 70
    got = f.audit(records(spark, []), records(spark, rows[:3])).collect()
    assert sorted((r.node, r.left_hash, r.from_offset) for r in got) == [(0, None, 0), (1, None, 9), (2, None, 19)]
    assert f.audit(records(spark, []), records(spark, [])).collect() == []
    assert f.archive_root(f.file_trees(records(spark, []))[1]) is None


def test_null_keys_repeated_rows_and_pages_with_nulls(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "é", 2), (1, "u", "é", 2), (9000, None, "x" * 100_000, 3)], "page_id long, url string, html string, record int")
    a = f.warc_records(pages)
    assert sorted(r.file for r in a.collect()) == [-1, 0, 0, 2]
    assert found(f.audit(a, a)) == []
    assert b"Content-Length: 2\r\n\r\n\xc3\xa9\r\n\r\n" in bytes(a.where("key = 1").first().record)
    assert found(f.audit(a, a.where("key IS NOT NULL"))) == [(-1, 0, None)]
    assert len(found(f.audit(a, a.dropDuplicates()))) == 1


def test_equal_archives_are_told_by_one_hash(spark, monkeypatch):
    rows = sample()
    compared = []
    plain = f._mismatches
    monkeypatch.setattr(f, "_mismatches", lambda *x, **y: compared.append(x[2]) or plain(*x, **y))
    assert found(f.audit(records(spark, rows), records(spark, rows))) == []
    assert compared.count([]) == 1


def test_a_large_file_and_many_copies_are_placed_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(f, "PART_RECORDS", 16)
    monkeypatch.setattr(f, "COPIES", 7)
    rows = [(0, None, b"same")] * 50 + [(0, 5, b"other")] * 30 + [(0, i, f"r{i}".encode()) for i in range(10, 60)] + [(None, 3, b"no file"), (9_000_000, 1, b"far")]
    hurt = [*rows[:90], (0, 20, b"r2!"), *rows[91:]]
    assert rows[90] == (0, 20, b"r20")
    placed = sorted((r.node, r.from_offset, r.to_offset, r.key) for r in f.leaves(records(spark, rows)).where("file = 0").collect())
    at, want = 0, []
    for n, (_, k, rec) in enumerate(sorted(rows[:130], key=lambda r: (r[1] is not None, r[1] or 0))):
        want.append((n, at, at + len(rec), k))
        at += len(rec)
    assert placed == want
    assert found(f.audit(records(spark, rows), records(spark, hurt), fanout=4)) == [(0, 90, 20)]
    assert found(f.audit(records(spark, rows), records(spark, rows[:-1]))) == [(9_000_000, 0, 1)]
    one = [(i, i, bytes([i])) for i in range(40)]
    assert found(f.audit(records(spark, one), records(spark, [*one[:7], (7, 7, b"?"), *one[8:]]))) == [(7, 0, 7)]
