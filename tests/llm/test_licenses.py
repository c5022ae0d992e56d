import random
import re

from karstline.llm import licenses as lic

BREAK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(BREAK, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w, out = words(t), []
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in out]
    return len(w), len(out), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in out}))


def test_base_columns_match_brute_force(spark, docs):
    rng = random.Random(9)
    parts = ["MIT", "license", "License.", "apache", "general", "Public", "É", "x", "-", "gpl", "K", "mit_license", "é1"]
    texts = [None, "", "license", "mit\x00license", *[" ".join(rng.choice(parts) for _ in range(n)) for n in (3, 10, 50, 400) for _ in range(5)]]
    for r in lic.scan(docs(texts)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_found_whole_edited_and_repeated(spark, docs):
    bsd = next(t for label, t in lic.TEMPLATES if label == "bsd")
    w = bsd.split()
    edited = " ".join(w[:6] + ["really"] + w[6:12] + w[13:])
    noise = "some words that say nothing at all "
    texts = [bsd, noise + edited + " " + noise, noise * 40, bsd.upper() + "\n" + noise * 5 + bsd, " ".join(w[:5]), "x Licensed under CC BY-NC 4.0. y", " ".join(sorted(w))]
    got = {r.doc_id: r for r in lic.scan(docs(texts)).collect()}
    assert [got[i].labels for i in range(7)] == ["bsd", "bsd", "", "bsd", "", "cc-by-nc", ""]
    assert got[0].score == 1 and lic.SIMILARITY <= got[1].score < 1 and got[2].score == 0
    spans = sorted((r.first_word, r.after_word) for r in lic.find_spans(docs(texts)).where("id = 3").collect())
    n = len(words(bsd))
    assert spans == [(0, n), (n + 35, 2 * n + 35)]


def test_repeated_null_ids_clashing_columns_and_empty(spark, docs):
    t = "Released under the MIT License."
    frame = docs([(None, t), (1, t), (1, t), (1, "no"), (2, None)]).selectExpr("*", "1 AS id", "2 AS hash", "3 AS w", "4 AS gram")
    got = sorted((str(r.doc_id), r.labels) for r in lic.scan(frame).collect())
    assert got == [("1", ""), ("1", "mit"), ("1", "mit"), ("2", ""), ("None", "mit")]
    assert lic.scan(docs([])).collect() == []


def test_no_python_in_the_plan(spark, docs, capsys):
    lic.scan(docs(["a"])).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def plain_spans(text, k=lic.GRAM_WORDS):
    """Diagonal voting over one text, template by template."""
    w, out = words(text), set()
    for label, template in lic.TEMPLATES:
        t, votes = words(template), {}
        grams = {}
        for j in range(len(t) - k + 1):
            grams.setdefault(tuple(t[j : j + k]), []).append(j)
        for i in range(len(w) - k + 1):
            for j in grams.get(tuple(w[i : i + k]), ()):
                votes.setdefault(i - j, set()).add(i)
        runs = []
        for first, d in sorted((min(p), d) for d, p in votes.items()):
            if runs and first - runs[-1][-1][1] <= lic.GAP_WORDS and abs(d - runs[-1][-1][0]) <= lic.DIAGONALS:
                runs[-1].append((d, max(votes[d]) + k, len(votes[d])))
            else:
                runs.append([(d, max(votes[d]) + k, len(votes[d]))])
        for run in runs:
            n = sum(x[2] for x in run)
            if n >= lic.VOTES * (len(t) - k + 1):
                a, b = max(0, min(x[0] for x in run)), min(len(w), max(x[0] for x in run) + len(t))
                mine, whole = " ".join(w[a:b]), " ".join(t)
                right = 1 - distance(mine, whole) / max(len(mine), len(whole))
                if right >= lic.SIMILARITY:
                    out.add((label, a, b, n, round(right, 9)))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_match_plain_diagonal_voting(spark, docs):
    rng = random.Random(6)
    texts = [None, ""]
    for label, t in lic.TEMPLATES:
        w = t.split()
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randrange(len(w) // 5 + 1)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice([[], ["odd"], ["two", "more"]])
            cut = x[: rng.randrange(len(x) // 2, len(x) + 1)]
            texts.append(" ".join(["before", "it"] * rng.randrange(4) + rng.choice([x, x, cut, cut + ["between"] + x]) + ["after"] * rng.randrange(3)))
    got = {}
    for r in lic.find_spans(docs(texts)).collect():
        got.setdefault(r.id, set()).add((r.label, r.first_word, r.after_word, r.votes, round(r.similarity, 9)))
    assert got == {i: p for i, t in enumerate(texts) if (p := plain_spans(t))} and len(got) > 60
    for r in lic.scan(docs(texts)).collect():
        spans = got.get(r.doc_id, set())
        assert r.labels == ",".join(sorted({x[0] for x in spans} | set(filter(None, base(texts[r.doc_id])[4].split(",")))))
        assert round(r.score, 9) == max((x[4] for x in spans), default=lic.BASE_SCORE if r.n_base else 0)


def test_other_phrases_are_not_gated_by_the_usual_ones(spark, docs, monkeypatch):
    monkeypatch.setattr(lic, "PHRASES", {"public domain": "pd"})
    rows = lic.scan(docs(["In the Public\tDomain, public domain", "license"]), templates=[("x", "one two three four")]).collect()
    assert sorted((r.doc_id, r.n_base, r.labels) for r in rows) == [(0, 2, "pd"), (1, 0, "")]
