"""Collocations, the size-aware Jaccard join and fill-in-middle: against brute force, and on odd rows and tables."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnspark.llm import collocations, fill_middle, jaccard_join

LONG = " ".join(f"w{k % 977}" for k in range(60_000))
EXTRA = ("a", "b", "n", "phrase", "f", "k1", "node", "token", "form", "output", "row")


def crowded(df):
    """df with columns that are called like those which operators make."""
    return df.withColumns({c: F.lit("x") for c in EXTRA})


# --- collocations ---


def plain_collocations(rows, max_words, min_count, covered, top):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(4, 3, 80, 2000), (3, 2, 50, 5), (2, 4, 80, 100), (4, 1, 100, 40)])
def test_collocations_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(collocations, "BLOCK", 2000)  # several blocks a task
    draw = random.Random(3)
    words = ["New", "york", "the", "CITY", "of", "ﬁ", "Žluť", "a", "\U0001f600", "x\x00"]
    ends = [" ", "  ", "\t", ". ", ",", "\n", "! ", "\r\n", ";", "\xa0"]
    rows = []
    for k in range(300):
        text = "".join(draw.choice(words) + draw.choice(ends[:3] * 6 + ends) for _ in range(draw.randrange(40)))
        rows.append((k, text + draw.choice(["", " new york city of the", " of the city"]), draw.choice(["en", "fr", None, "", "und"])))
    rows += [(1000, None, "en"), (1001, "", None), (1002, "...,,,", "en"), (None, "no id no id no id", "en"), (None, "no id no id no id", "en")]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string, lang string")).repartition(5)
    max_words, min_count, covered, top = shape
    got = collocations.collocations(df, max_words=max_words, min_count=min_count, covered_percent=covered, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    # an empty language is a language like others
    want = plain_collocations([(t, lang) if lang != "" else (t, "") for _, t, lang in rows if lang != ""], max_words, min_count, covered, top)
    assert sorted(tuple(r) for r in got.filter("lang <> ''").collect()) == want


def test_collocations_on_odd_tables(spark):
    df = spark.createDataFrame([(1, LONG, "en")], "doc_id long, text string, lang string")
    got = collocations.collocations(df, min_count=60)
    assert got.filter("n <> 60000").count() == 0 and got.filter("a < 60").count() == 0 and got.count() > 900
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df, min_count=10**6).count() == 0


def test_a_full_filter_of_pairs_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "LEAST_BITS", 8)
    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    rows = [(k, f"in the end of the day {k % 3} we saw the end of it, and that is that", "en") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(tuple(r) for r in collocations.collocations(df, min_count=5).collect())
    assert got == plain_collocations([(t, lang) for _, t, lang in rows], 4, 5, 80, 2000)


# --- the join ---


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = brute.WORD.findall((t or "").translate(brute.LOWER))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    return out


def test_groups_of_edited_copies_and_a_shared_passage(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    passage, rows = [word() for _ in range(30)], []
    for group in range(6):
        base = [word() for _ in range(draw.choice([12, 30, 80, 200]))]
        for _ in range(40):
            w = list(base)
            for _ in range(draw.randrange(4)):
                w[draw.randrange(len(w))] = word()
            rows.append(w)
    rows += [[word() for _ in range(draw.randrange(3, 40))] + passage for _ in range(120)]  # a passage in texts that are not alike
    rows += [[word() for _ in range(draw.randrange(1, 9))] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for size, percent in ((4, 85), (2, 60)):
        want = {i: (n, c) for i, (n, c, _) in brute.components(rows, size, percent).items()}
        sets = sets_of(rows, size)
        first = {}
        for i in sorted(sets):
            first.setdefault(sets[i], i)
        links = {(a, b) for (x, a), (y, b) in itertools.combinations([p for p in first.items() if p[0]], 2) for a, b in [sorted((a, b))] if 100 * len(x & y) >= percent * len(x | y)}
        for boundary in (None, 0, 10**6):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, shingle=size, percent=percent, boundary=boundary).collect()}
            assert got == want
        pairs = [(r.a, r.b) for r in jaccard_join.jaccard_links(df, shingle=size, percent=percent).collect()]
        assert set(pairs) == links and len(pairs) == len(links)


def test_the_join_splits_what_many_hold(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOLDERS", 3)
    monkeypatch.setattr(jaccard_join, "LEVELS", (2, 3, 4, 5))
    draw = random.Random(6)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(draw.randrange(9)):
            w[draw.randrange(60)] = f"x{k}{draw.random()}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = {i: (n, c) for i, (n, c, _) in brute.components(rows, 4, 85).items()}
    for boundary in (0, 10**6):
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, shingle=4, percent=85, boundary=boundary).collect()} == want


def test_the_join_on_odd_rows(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog"), (2, "the QUICK brown fox jumps over the lazy dog"), (2, "one two three four five six seven"), (5, "one two three four five six seven"), (3, None), (4, ""), (7, " \t\n"), (6, LONG), (9, LONG), (8, "one two"), (10, "one two"), (None, "the quick brown fox jumps over the lazy dog"), (None, None)]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, shingle=4, percent=85).collect())
    # 2 stands on two texts, so 1 and 5 are linked through it
    assert got == Counter([(1, 6, 1), (2, 6, 1), (2, 4, 1), (5, 4, 1), (3, 0, 3), (4, 0, 4), (7, 0, 7), (6, 977, 6), (9, 977, 6), (8, 1, 8), (10, 1, 8), (None, 6, None), (None, 0, None)])
    for f in (jaccard_join.jaccard_components, jaccard_join.jaccard_links):
        assert f(df.filter("doc_id = -1")).count() == 0
    assert jaccard_join.jaccard_links(df.filter("doc_id IN (3, 4, 8, 10)")).count() == 0


# --- middles ---


@pytest.mark.parametrize("unit", fill_middle.UNITS)
@pytest.mark.parametrize("every", [1, 3, 64])
def test_checkpoints_find_each_unit(monkeypatch, unit, every):
    monkeypatch.setattr(fill_middle, "STEP", 7)  # pieces end inside code points
    draw = random.Random(1)
    for _ in range(60):
        text = "".join(draw.choice("ab\n é\U0001f600ﬁ́") for _ in range(draw.randrange(60)))
        index = fill_middle.Checkpoints(np.frombuffer(text.encode(), dtype=np.uint8), unit, every)
        units = list(text) if unit == "code_point" else re.findall(r"[^\n]*\n|[^\n]+", text)
        assert index.n == len(units) and index.n_chars == len(text) and len(index.units) == -(-len(units) // every)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.cut(k) == (len(before.encode()), len(before))
    with pytest.raises(ValueError, match="unit"):
        fill_middle.Checkpoints(np.zeros(0, dtype=np.uint8), "page")


def test_fill_in_middle(spark):
    texts = ["", None, "a", "plain text here\nand more", "has <P> in it", "<M>", "<", "<S", "S>", "é\U0001f600ﬁ" * 50, "x" * 100_000, "line\nline\n" * 30]
    rows = [(k, t) for k, t in enumerate(texts * 40)] + [(None, "no id"), (None, "no id"), (3, "other text of 3")]
    df = crowded(spark.createDataFrame(rows, "doc_id long, text string")).repartition(4)
    out = fill_middle.fill_in_middle(df)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())

    def plain(i, text):
        t = text or ""
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            return i, len(t), "plain", None, None, t
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if h4 % 100 < 20:
            return i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        return i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"

    assert got == Counter(plain(i, t) for i, t in rows) and {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    back = fill_middle.restore(out)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    lines = fill_middle.fill_in_middle(df, unit="line", plain_percent=0, seed=9)
    assert Counter((r.doc_id, r.text) for r in fill_middle.restore(lines).collect()) == Counter((i, t or "") for i, t in rows)
    for r in lines.filter("form = 'psm'").collect():
        prefix = re.match(r"<P>(.*?)<S>", r.output, re.S).group(1)
        assert len(prefix) == r.prefix_chars and (not prefix or prefix.endswith("\n") or r.middle_chars == 0)
    assert fill_middle.fill_in_middle(df.filter("doc_id = -1")).count() == 0
