"""The training-data operators against brute-force versions on small hard inputs."""

import hashlib
import random
import re
import time
import zlib
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import pytest

from entweave.llm import decontaminate, language_id, line_dedup, minhash, packing, quality_classifier, substring_dedup, suffix_dedup, topk, url_filter
from entweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component string, n string, h string"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def word(r):
    return "".join(r.choice(["an", "ti", "ou", "ré", "ß", "Th", "ea"]) for _ in range(r.randint(1, 3)))


@pytest.fixture(scope="module")
def texts():
    """Ids to texts: copies, near copies, shared passages, periodic and very long texts, blanks, nulls."""
    r = random.Random(3)
    sentence = lambda: " ".join(word(r) for _ in range(r.randint(1, 14))) + r.choice([".", "!", "?"])
    passage = " ".join(sentence() for _ in range(12))
    texts = {}
    for i in range(60):
        lines = [" ".join(sentence() for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 8))]
        if i % 7 == 0:
            lines.insert(r.randint(0, len(lines)), passage)
        texts[i] = "\n".join(lines)
    for i in range(60, 80):
        words = texts[i % 5].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = word(r)
        texts[i] = " ".join(words)
    texts |= {80: None, 81: "", 82: " \n\t ", 83: "one", 84: "one", 85: "ab" * 400, 86: "x" * 150, 87: "x" * 250, 88: "Aé " * 90_000, 89: texts[0]}
    texts[90] = " ".join(texts[2].split()[5:])  # begins in the middle of another's windows
    return texts


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "k", "c", "n", "h") for i, t in texts.items()]
    rows += [rows[3], (None, texts[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for row in df.collect():
        assert out.setdefault(row["doc_id"], row) == row or row["doc_id"] is None, "repeated rows differ"
        out[row["doc_id"]] = row
    return out


def lower_words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(docs, texts, n):
    sets = {}
    for i, t in texts.items():
        w = lower_words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(minhash.near_duplicates(docs, words=n))
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), find(i), find(i) == i), i
    assert got[None].component_id is None and got[None].kept


def test_minhash_finds_links_that_the_star_misses(spark):
    r = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(40):  # variants of one text that are less alike to each other than to it; the base comes last
        words = list(base)
        for k in r.sample(range(200), 9):
            words[k] = f"v{i}-{k}"
        rows.append((i, " ".join(words)))
    rows.append((99, " ".join(base)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2))
    assert {x.component_id for x in got.values()} == {0}


def test_minhash_texts_of_one_id(spark):
    """Rows that share a doc_id have the links of all their texts."""
    line = lambda tag, last: " ".join([f"{tag}{k}" for k in range(60)] + [last])
    rows = [(1, line("a", "x")), (1, line("b", "x")), (1, line("c", "x")), (2, line("a", "y")), (3, line("b", "y")), (4, line("c", "y")), (5, line("d", "y"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, i) for i in (2, 3, 4, 5)], "a long, b long")
    assert {(x.a, x.b) for x in minhash._confirm_stars(pairs, docs, 2, 80).collect()} == {(1, 2), (1, 3), (1, 4)}
    got = {(x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(docs, words=2).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)}


def template_pages(n, seed=3):
    """Pages of one template that are about 0.75 alike, and a copy of every fortieth with one word changed."""
    r = random.Random(seed)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for k in r.sample(range(150), 11):
            words[2 * k] = f"v{i}-{k}"
        rows.append((i, " ".join(words)))
        if i % 40 == 0:
            words[1] = "other"
            rows.append((n + i, " ".join(words)))
    return rows


def test_minhash_pairs_of_template_pages_grow_with_the_pages(spark, monkeypatch):
    """Bucket members of one template aren't put out as pairs; links stay those of a brute force."""
    made = []
    keep = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    for n in (200, 400):
        made.clear()
        rows = template_pages(n)
        sets = {i: set(zip(t.split(), t.split()[1:])) for i, t in rows}
        root = {i: i for i in sets}
        find = lambda x: x if root[x] == x else find(root[x])
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        pages = spark.createDataFrame(rows, "doc_id long, text string")
        got = {x.doc_id: x.component_id for x in minhash.near_duplicates(pages, words=2).collect()}
        assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(rows)
        most = max(df.count() for name, df in made if name in ("edges", "links"))
        assert n / 2 < most <= minhash.BANDS * len(rows) / 4, most  # all pairs: n * n / 2


def test_forests_connect_what_all_pairs_connect():
    r = random.Random(11)
    base = list(range(60))
    for trial in range(40):
        n = r.randint(2, 40)
        sets = [np.unique(np.array([x if r.random() > 0.12 * (trial % 3) else 1000 + r.randrange(80) for x in base[: r.randint(30, 60)]], np.uint64)) for _ in range(n)]
        comps = [r.randrange(n) for _ in range(n)]
        ids = list(range(n))
        for pairs, seed in ((minhash.linking_forest(ids, comps, sets, 80), comps),):
            truth = [(i, j) for i in ids for j in ids if i < j and comps[i] != comps[j] and minhash._alike(sets[i], sets[j], 80)]
            assert set(pairs) <= set(truth) and len(pairs) < max(2, len(set(comps)))

            def classes(edges):
                root = {c: c for c in seed}
                find = lambda x: x if root[x] == x else find(root[x])
                for i, j in edges:
                    root[find(seed[i])] = find(seed[j])
                return {frozenset(c for c in root if find(c) == k) for k in {find(c) for c in root}}

            assert classes(pairs) == classes(truth)


def test_signature_agreement_is_the_similarity():
    r = np.random.default_rng(1)
    for size in (3, 40, 2000):
        hits = []
        for _ in range(60):
            pool = r.integers(0, 1 << 63, size + size // 4 + 1).astype(np.uint64)
            a, b = pool[:size], pool[len(pool) - size :]
            hits.append((minhash.signature(a) == minhash.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(hits)) < 0.05


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 300])
def test_suffix_dedup(docs, texts, hot, monkeypatch):
    seen, expect = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                covered[p : p + 100] = b"\1" * 100
            else:
                seen.add(s)
        expect[i] = (len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), sha(bytes(c for c, v in zip(b, covered) if not v)))
    got = by_id(suffix_dedup.dedup_suffixes(docs, hot=hot).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) k"))
    for i, e in expect.items():
        assert tuple(got[i])[1:] == e, i
    assert got[None].n_removed == 0


def test_copies_are_not_moved_as_bytes(spark, monkeypatch):
    """Of texts that occur several times no segment is cut out: one distinct segment needs no order.  A text that repeats in itself is."""
    r = random.Random(23)
    fresh = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    same, half = fresh(3000), fresh(1500)
    texts = {1: same, 2: fresh(2000), 3: same, 4: "", 5: same + fresh(150), 6: half + "|" + half}
    tables, written = {}, suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    rows = [*texts.items(), (1, same)]
    got = by_id(suffix_dedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).dropDuplicates(["doc_id"]))
    assert [got[i].n_removed for i in sorted(texts)] == [0, 0, 3000, 0, 3000, 1500]
    pieces = [x.doc_id for x in tables["segments"].collect()]
    assert set(pieces) == {1, 5, 6} and pieces.count(1) <= 4 and pieces.count(5) <= 4  # where 5's own text joins on
    assert got[6].n_spans == 1 and bytes(got[6].kept).decode() == half + "|"


def test_shuffle_files_of_written_tables_go_at_once(spark):
    from pyspark.sql import functions as F

    files = lambda: sum(f.getName().startswith("shuffle_") for f in map(held.apply, range(held.size())))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held, set_before = manager.getAllFiles(), spark.conf.get(key)
    before = files()
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = suffix_dedup.written(df, "seven")
    for _ in range(50):
        held = manager.getAllFiles()
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == set_before
    assert sum(x["count"] for x in table.collect()) == 1000


def test_hot_minimizers_leave_batches_as_they_were(spark, monkeypatch):
    """One minimizer in every text, beyond `hot`: its path works in small batches, what comes after doesn't."""
    r = random.Random(5)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    common = some("abcdefgh", 40)
    rows = [(i, some("ijklmnop", 60) + common + some("ijklmnop", 60)) for i in range(300)]
    rows.append((500, "z" + rows[7][1]))
    names, written = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: names.append(name) or written(df, name))
    found = suffix_dedup.repeated_starts(spark.createDataFrame(rows, "doc_id long, text string"), hot=2000)
    assert "hot" in names and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert sorted({(x.doc_id, i) for x in found.collect() for i in range(x.lo, x.hi)}) == [(500, i) for i in range(1, 62)]


def test_minimizer_flags_follow_all_hashes():
    """A segment's flag says whether its minimizer occurs twice in the text, wherever it does."""
    r = random.Random(31)
    for n in (100, 131, 700, 4000):
        raw = bytes(r.choice(b"ab") for _ in range(n // 2)) * 2 + b"c" * (n % 7)
        if len(raw) < 100:
            continue
        hashes = suffix_dedup._gram_hashes(np.frombuffer(raw, np.uint8), 32).view(np.int64).tolist()
        least = [min(np.array(hashes[i : i + 69], np.int64).view(np.uint64).tolist()) for i in range(len(raw) - 99)]
        head, first, end, twice = (x.tolist() for x in suffix_dedup.segments(raw))
        assert [h for h, a, b in zip(head, first, end) for _ in range(a, b)] == np.array(least, np.uint64).view(np.int64).tolist()
        assert twice == [hashes.count(h) > 1 for h in head]


def test_longest_previous_factors():
    r = random.Random(2)
    for trial in range(20):
        pool = bytes(r.choice(b"ab" if trial % 2 else b"a") for _ in range(90)) * 2
        parts = [pool[i : i + r.randint(12, 60)] for i in r.sample(range(100), 12)]
        doc, start = [r.randrange(9) for _ in parts], [r.randint(0, 50) for _ in parts]
        places = [(d, s + i, p[i : i + 12]) for p, d, s in zip(parts, doc, start) for i in range(len(p) - 11)]
        shared = lambda x, y: next((k for k in range(12) if x[k] != y[k]), 12)
        want = [max((shared(w, v) for e, t, v in places if (e, t) < (d, s)), default=0) for d, s, w in places]
        assert suffix_dedup.longest_previous(parts, np.array(doc), np.array(start), 12).tolist() == want
    p = np.array([r.randrange(50) for _ in range(500)] + list(range(60, 0, -1)))
    assert suffix_dedup.previous_smaller(p).tolist() == [max((j for j in range(i) if p[j] < p[i]), default=-1) for i in range(len(p))]


def test_large_groups_are_cut_by_longer_minimizers(monkeypatch):
    r = random.Random(4)
    text = bytes(r.choice(b"abcdefgh") for _ in range(6000)) + b"x" * 400
    parts = [text[i : i + r.randint(100, 900)] for i in r.sample(range(5900), 60)] + [b"x" * 150, b"x" * 220, b"y" * 130]
    doc, start = list(range(len(parts))), [r.randint(0, 50) for _ in parts]
    spread = lambda runs: sorted((d, i) for d, lo, hi in runs for i in range(lo, hi))
    want = spread(suffix_dedup.matched(parts, doc, start))
    assert want
    for most in (20_000, 300, 0):
        monkeypatch.setattr(suffix_dedup, "SORT_BYTES", most)
        monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 1000)
        assert spread(suffix_dedup.matched(parts, doc, start)) == want, most


def split_sentences(text):
    """Sentences by a scan of characters; for texts without sentences of over 40 words."""
    out, now, text = [], "", text or ""
    for k, c in enumerate(text):
        now += c
        rest = text[k + 1 :]
        stop = now.rstrip()[-1:]
        if c == "\n" and not rest[:1].isspace() or c.isspace() and not rest[:1].isspace() and (stop in (".", "!", "?", "…") or "\n" in now[len(now.rstrip()) :]):
            out.append(now)
            now = ""
    return out + [now] if now else out


def test_substring_dedup(spark, texts):
    """All runs of all lengths against each other: a sentence goes if it lies in a run of 20 words, or of 3 sentences and 12 words, that
    occurs earlier.  The library hashes shortest runs only, cuts and counts by other code."""
    texts = {i: t for i, t in texts.items() if i not in (85, 86, 87, 88)}
    got = by_id(substring_dedup.op1(spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string").repartition(4)))
    seen, cut = {}, {}
    for i in sorted(texts):
        full = [(k, " ".join(p.split())) for k, p in enumerate(split_sentences(texts[i])) if p.split()]
        assert all(len(s.split()) <= 40 for _, s in full)
        gone = set()
        for at in range(len(full)):
            for end in range(at + 1, min(len(full), at + 24) + 1):
                run = tuple(s for _, s in full[at:end])
                size = sum(len(s.split()) for s in run)
                if end - at == 3 and size >= 12 or size >= 20:
                    if seen.setdefault(run, (i, at)) != (i, at):
                        gone |= {k for k, _ in full[at:end]}
        cut[i] = len(gone)
        kept = "".join(p for k, p in enumerate(split_sentences(texts[i])) if k not in gone)
        assert (got[i].n_sentences, got[i].n_removed, got[i].kept_sha256) == (len(full), len(gone), sha(kept.encode())), i
    assert got[89].n_removed == got[89].n_sentences and 0 < sum(v > 0 for v in cut.values()) < len(cut)  # a copy goes whole


def test_substring_runs_of_short_sentences_and_passages_in_endless_ones(spark):
    r = random.Random(20)
    flow = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(n))
    passage = flow(90)
    rows = {1: "Own one. He came. She saw it all. They left. Own end.", 2: "He came.  She saw it all.\nThey left. Another.", 3: f"{flow(33)} {passage} {flow(51)}", 4: f"{flow(57)} {passage} {flow(28)}"}
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert [got[i].text for i in (1, 2, 3)] == [rows[1], "Another.", rows[3]]
    left = set(got[4].text.split())
    assert len(left & set(passage.split())) <= 45 and set(rows[4].split()) - set(passage.split()) <= left
    for text in (rows[3], "字" * 300, "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(500))):
        parts = substring_dedup.sentences(text)
        assert "".join(parts) == text and max(map(substring_dedup.n_words, parts)) <= 40


def test_substring_dedup_short_runs_and_unspaced(spark):
    """Pairs of sentences, a long sentence's rest and texts without spaces go once they have 20 words."""
    line = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n)) + ". "
    han = "".join(chr(0x4E00 + 7 * k) for k in range(90))
    zh = f"{han[:30]}。{han[30:60]}！{han[60:]}。"
    rows = {
        1: line(16, "a") + line(17, "b") + line(19, "c") + line(7, "d"), 2: "Own one. " + line(16, "a") + line(17, "b") + "Own end.", 3: "Own two. " + line(19, "c") + line(7, "d") + "Own last.",
        4: line(45, "e"), 5: "Own three. " + line(45, "e") + "Own four.", 6: line(10, "f") + line(9, "g"), 7: "Own five. " + line(10, "f") + line(9, "g"),
        8: zh, 9: "独自文。" + zh + "又独自文。", 10: han, 11: han, 12: "ไ" * 90, 13: "ไ" * 90,
    }
    got = {x.doc_id: x.text for x in substring_dedup.dedup_substrings(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    want = {2: "Own one. Own end.", 3: "Own two. Own last.", 5: "Own three. Own four.", 9: "独自文。又独自文。", 11: "", 13: ""}
    assert got[12] and not got[13]
    assert {i: t for i, t in got.items() if i != 12} == {i: want.get(i, t) for i, t in rows.items() if i != 12}
    r = random.Random(12)
    for _ in range(300):  # every sentence of a repeated run of 20 words lies in a run inside it
        parts = [line(r.randint(1, 30), r.choice("xyz")) for _ in range(r.randint(1, 12))]
        inside = substring_dedup.runs(parts)
        covered = {k for at, n, _ in inside for k in range(at, at + n)}
        assert covered == (set(range(len(parts))) if sum(len(p.split()) for p in parts) >= 20 or len(parts) >= 3 else set())


def test_line_dedup(docs, texts):
    got = by_id(line_dedup.op4(docs))
    seen = {}
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n") if texts[i] else []
        full = [(k, " ".join(x.split())) for k, x in enumerate(lines) if x.split()]
        gone = set()
        for n in (1, line_dedup.WINDOW):
            for at in range(len(full) - n + 1):
                if n > 1 or len(full[at][1]) >= line_dedup.LONG_LINE:
                    key = (n, tuple(x for _, x in full[at : at + n]))
                    if seen.setdefault(key, (i, at)) != (i, at):
                        gone |= {k for k, _ in full[at : at + n]}
        kept = [x for k, x in enumerate(lines) if k not in gone]
        text = ("\n".join(kept) if any(x.strip() for x in kept) else "") if gone else texts[i] or ""
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_sha256) == (len(full), len(gone), sha(text.encode())), i


def test_line_dedup_by_size(spark, docs, texts):
    """With min_words, repeated runs of one or two lines go once they have that many words."""
    line = lambda n, tag: " ".join(f"{tag}{k}" for k in range(n))
    a, b, c = line(12, "a"), line(9, "b"), line(25, "c")
    short = {1: f"{a}\n{b}\n{c}", 2: f"{a}\n\n{b}", 3: f"own line\n{a}\n {b}", 4: c, 5: f"{c}\nother", 6: a, 7: b, 8: f"{b}\n{a}", 9: f"{line(10, 'd')}\n{line(9, 'e')}", 10: f"{line(10, 'd')}\n{line(9, 'e')}"}
    rows = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    left = {x.doc_id: x.text for x in line_dedup.dedup_lines(rows, min_words=line_dedup.MIN_WORDS).collect()}
    assert left == {**short, 2: "", 3: "own line", 4: "", 5: "other"}
    got = {x.doc_id: x for x in line_dedup.dedup_lines(docs, min_words=6).collect()}
    seen = {}
    for i in sorted(texts):
        full = [x.split() for x in (texts[i] or "").split("\n") if x.split()]
        gone = set()
        for n in (1, 2, line_dedup.WINDOW):
            for at in range(len(full) - n + 1):
                run = full[at : at + n]
                if n == line_dedup.WINDOW or sum(map(len, run)) >= 6 or n == 1 and len(" ".join(run[0])) >= line_dedup.LONG_LINE:
                    key = str(run)
                    if seen.setdefault(key, (i, at)) != (i, at):
                        gone |= set(range(at, at + n))
        assert (got[i].n_lines, got[i].n_removed) == (len(full), len(gone)), i


def test_winnowing_guarantee():
    r = random.Random(4)
    for _ in range(200):
        keys = [bytes([r.randrange(6)]) for _ in range(r.randint(0, 30))]
        chosen = line_dedup.selected(keys, 3)
        assert all(any(i <= c < i + 3 for c in chosen) for i in range(len(keys) - 2))


def test_decontaminate(spark, docs, texts):
    r = random.Random(6)
    items = [(7, texts[2][:150]), (7, texts[2][100:260]), (10, "one"), (11, None), (12, "  "), (None, texts[5]), (13, texts[11].upper()[:90]), (9, " ".join(word(r) for _ in range(20)))]
    got = by_id(decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")))
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 7)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    for i, t in texts.items():
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        assert tuple(got[i])[1:] == (len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(found) >= 2), i


def test_decontaminate_by_shuffle_and_proximity(spark, docs, texts, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(texts[2].split()[:9]))], "item_id long, text string")
    phrase = sorted(map(tuple, decontaminate.matches(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, decontaminate.matches(docs, items).collect())) == phrase and phrase
    made = []
    keep = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: made.append((name, df)) or keep(df, name))
    long = [(1, " ".join(f"w{k % 977}" for k in range(20_000))), (2, None), (3, "w1 w2")]
    found = decontaminate.matches(spark.createDataFrame(long, "doc_id long, text string"), spark.createDataFrame([(5, " ".join(f"w{k}" for k in range(900, 912)))], "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.at) for x in found) == [(1, 977 * n + k) for n in range(20) for k in range(900, 905)]
    postings = next(df for name, df in made if name == "postings")
    plan = spark._jvm.PythonSQLUtils.explainString(postings._jdf.queryExecution(), "formatted")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert any("near" in x for x in moved) and not any("words" in x or "text" in x for x in moved), moved
    mixed = texts[2].split()[:9]
    mixed[1], mixed[2] = mixed[2], mixed[1]
    other = spark.createDataFrame([(1, " ".join(mixed[:8]))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.matches(docs, other, proximity=True).collect()} >= {2}


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.op7(docs).collect()
    places, pieces = {}, {}
    for x in rows:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
        pieces.setdefault(x.doc_id, {}).setdefault(x.piece, []).append(x)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for n, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            for x in pieces[i][n]:
                assert (x.start, x.length, x.ids_crc32) == (at // 4, len(part) // 4, zlib.crc32(part)), (i, n)
        assert len(pieces[i]) == n + 1
    total = sum(x.length for x in rows)
    assert len(places) <= -(-total // 4096) + 1
    assert len(pieces[3][0]) == 2


@pytest.mark.parametrize("text", ["Straße's can't İstanbul ΑΣ ½ x²", "a\x1cb\x85c\xa0d", "<|endoftext|> <|x|>", "é é ﬁ", "naïve—“quoted”… it's 12,5 €", "字母 и буквы", "a" * 3000])
def test_encoder_is_the_tokenizer(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    expect = np.array([*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert packing.Encoder(path).batch([text]) == [expect]


def test_best_fit_is_close_to_full():
    sizes = np.random.default_rng(0).integers(1, 3000, 2000)
    where, offset, used = packing.best_fit(sizes)
    assert len(used) <= 1.01 * sizes.sum() / 4096 + 1 and max(used) <= 4096
    assert sorted(np.bincount(where, sizes).astype(int)) == sorted(used)


def places_of(rows, capacity=4096):
    held = {}
    for x in rows:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_packing_tree_holds_a_fixed_number_of_rows(spark, monkeypatch):
    """Bins that no merge can use don't climb; underfull ones of many tasks are still joined."""
    from pyspark.sql import functions as F

    merges = []
    keep = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: merges.append((name, keep(df, name))) or merges[-1][1])
    big = spark.range(0, 40_000, 1, 64).selectExpr("id as doc_id", "2100L as length")
    assert len(places_of(packing.pack(big).collect())) == 40_000
    rows = [df.groupBy("task").count().agg(F.max("count")).first()[0] for name, df in merges if name.startswith("merge")]
    assert len(rows) == 2 and max(rows) <= packing.FAN_IN * packing.LEVELS * packing.FAN_IN
    # one small piece in each partition beside large ones: the small ones fill the room of the large
    mixed = spark.range(0, 64 * 21, 1, 64).selectExpr("id as doc_id", "if(id % 21 = 20, 500L, 3000L + id % 7) as length")
    assert len(places_of(packing.pack(mixed).collect())) == 64 * 20
    # small bins of all partitions meet over two levels: 19 of 1,600 tokens, of which two fit a sequence
    few = spark.range(0, 300, 1, 300).selectExpr("id as doc_id", "100L as length")
    assert len(places_of(packing.pack(few).collect())) == 10


def brute_top(rows, k=10):
    """rows(vec_id, list of finite floats): by Python's integers; a repeated query is its smallest vector."""
    exact = [(i, v, [int((Fraction(x) * 1024) // 1) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, *_ in exact if i % 100 == 0}):
        own = min((v, n) for n, (i, v, _) in enumerate(exact) if i == q)[1]
        dim = len(exact[own][2])
        best = sorted((-sum(a * b for a, b in zip(exact[own][2], w)), i) for n, (i, _, w) in enumerate(exact) if n != own and len(w) == dim)[:k]
        out += [(q, r, i, max(1 - 2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(r.integers(-3, 3, (330, 4)) / 3)]
    bad = [(1000, None, 0), (1100, [float("nan"), 0.0, 0.0, 0.0], 0), (1200, [None, 1.0, 1.0, 1.0], 0), (None, [1.0] * 4, 0), (1300, [], 0), (1400, [1.0, 2.0], 0)]
    repeats = [(100, [9.0] * 4, 0), (100, [9.0] * 4, 0), rows[100], rows[7], (200, rows[3][1], 0)]
    for shard_bytes in (32 << 20, 500):
        got = topk.top_k(spark.createDataFrame(rows + bad + repeats, "vec_id long, embedding array<double>, label int"), tile=50, block=2, shard_bytes=shard_bytes).collect()
        want = brute_top([(i, v) for i, v, _ in rows + repeats])
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == want


def test_top_k_scores_stay_exact(spark):
    big = np.array([[2**40, 3]], np.int64)
    assert topk.scores(np.array([[2**20 + 1, 1]], np.int64), big)[0, 0] == (2**20 + 1) * 2**40 + 3
    assert topk.scores(big, big)[0, 0] == 2**80 + 9
    r = random.Random(3)
    rows = [(i, [r.choice([1e17, -1e17, 1.0, 1e308, -3e300, 5e-324, 0.1]), r.choice([1.0, -2.5, 1e17])]) for i in range(120)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=30, block=2).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == brute_top(rows)
    scores = [0, 1, -1, 2**63, 2**63 - 1, 1 - 2**63, -(2**63), -(2**700), 2**700, 2**700 + 1, -(2**64)]
    keyed = sorted(scores, key=lambda v: (max(1 - 2**63, min(2**63 - 1, v)), topk.exact_key(v) or b""))
    assert keyed == sorted(scores)


def test_url_filter(spark):
    r = random.Random(8)
    day = lambda n: datetime(2024, 1, 1) + timedelta(hours=n)
    urls = ["http://a.b.com/x/y?q=1", "https://u@B.com:80/x", "ftp://c.org", None, "no url", "http://a.b.com./x/z#f", "http:///p"]
    captures = [(i, r.choice(urls), day(r.randint(0, 2000)) if r.random() < 0.95 else None) for i in range(400)]
    patterns = [("host", "a.b.com"), ("host", "b.com"), ("domain", "b.com"), ("domain", "com"), ("prefix", "a.b.com/x"), ("prefix", "b.com/x"), ("odd", "c.org"), ("host", None)]
    log = [(*r.choice(patterns), r.choice(["s", "t", None]), r.choice(["add", "remove", "add", None]), day(r.randint(0, 2000))) for _ in range(90)]
    got = {x.page_id: x for x in url_filter.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"), spark.createDataFrame(log, "kind string, pattern string, category string, action string, since timestamp")).collect()}

    def keys(u):
        host = {"http://a.b.com/x/y?q=1": "a.b.com", "https://u@B.com:80/x": "b.com", "ftp://c.org": "c.org", "http://a.b.com./x/z#f": "a.b.com"}.get(u)
        if not host:
            return set()
        path = {"http://a.b.com/x/y?q=1": ["x", "x/y"], "https://u@B.com:80/x": ["x"], "http://a.b.com./x/z#f": ["x", "x/z"]}.get(u, [])
        labels = host.split(".")
        return {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", f"{host}/{p}") for p in path}

    for i, u, t in captures:
        active = set()
        for kind, pattern in keys(u) if t else ():
            for category in ("s", "t", ""):
                past = [(since, action != "remove") for k, p, c, action, since in log if (k, p, c or "") == (kind, pattern, category) and action and since <= t]
                if past and min(past, key=lambda x: (-x[0].timestamp(), x[1]))[1]:
                    active.add((kind, pattern, category))
        assert (got[i].n_active, got[i].blocked, got[i].categories) == (len(active), bool(active), ",".join(sorted({c for *_, c in active}))), (i, u, t)


def test_url_prefix_keeps_the_case_of_its_path(spark):
    day = datetime(2024, 1, 1)
    urls = ["http://a.com/Foo/x", "http://A.com/foo/x", "http://a.com/Foo", "http://a.com/Foot", "http://B.com/q/Q", "http://c.com/"]
    log = [("prefix", "A.com/Foo", "s", "add", day), ("prefix", "b.com/q/Q", "s", "add", day), ("host", "C.com", "s", "add", day)]
    got = url_filter.evaluate(spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched timestamp"), spark.createDataFrame(log, "kind string, pattern string, category string, action string, since timestamp"))
    assert {x.page_id for x in got.collect() if x.blocked} == {0, 2, 4, 5}


def test_language_id(spark, docs, empty):
    r = random.Random(9)
    vocabulary = {"aa": "the of and to in is that", "bb": "der die und das ist nicht ein", "cc": "το και της με για"}
    rows = [(i, " ".join(r.choice(vocabulary[lang].split()) for _ in range(r.randint(3, 60))), lang) for i in range(300) for lang in [r.choice("aa bb cc".split())]]
    rows += [(900, None, "aa"), (901, "12 34 !", "bb"), (902, "the of and", None), (None, "und das ist", "bb")]
    got = {x.doc_id: x for x in language_id.op9(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].lang_pred == lang for i, _, lang in rows[:300]) >= 297
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= x.score <= 1 and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got.values())
    long = "the of and " * 200_000
    a, n = language_id.gram_counts(long)
    b, m = language_id.gram_counts("the of and " * 1000)
    assert set(a) == set(b) and n.sum() > 190 * m.sum()


def test_language_distances_are_out_of_place_sums():
    """Rank lists, distances and scores by dictionaries and loops."""
    r = random.Random(31)

    def grams(text):
        count = {}
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            framed = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(framed) - n + 1):
                    g = framed[i : i + n]
                    if g.strip() and (n < 3 or g[1] != " "):
                        count[g] = count.get(g, 0) + 1
        return count

    packed = lambda g: sum((1 if c == " " else ord(c) + 1) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    top = lambda count, n: sorted((packed(g) for g in count), key=lambda p: (-{packed(g): c for g, c in count.items()}[p], p))[:n]
    text = lambda k: " ".join(word(r) for _ in range(k))
    profiles = {lang: top(grams(text(60)), 40) for lang in ("xx", "yy", "zz")}
    judge = language_id.Judge(profiles, 40)
    for k in (1, 3, 40, 200):
        t = text(k) + ", 12 ÉA!"
        own = top(grams(t), language_id.DOC_PROFILE)
        away = {lang: sum(min(abs(p.index(g) - i), 40) if g in p else 40 for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert judge(t) == (best, pytest.approx(1 - away[best] / (40 * len(own))))


def test_quality_steps_follow_the_gradient():
    """One step of one document against differences of the loss; and scores against the mean of embeddings by hand."""
    texts, labels = ["ab cd ab", "Xy 12, zz!"], [1, 0]
    rows = [np.concatenate(list(quality_classifier.feature_rows(t, 64))) for t in texts]
    dim = 3
    rng = np.random.default_rng(11)
    emb = rng.uniform(-1 / dim, 1 / dim, (64, dim)).astype(np.float32).astype(np.float64)
    out = rng.normal(0, 0.1, (2, dim)).astype(np.float32).astype(np.float64)
    rng.permutation(2)

    def loss(e, o, b):
        total = 0.0
        for r, y in zip(rows, labels):
            z = e[r].mean(0) @ o.T + b
            total += np.log(np.exp(z).sum()) - z[y]
        return total / 2

    model = quality_classifier.train_numpy(texts, labels, buckets=64, dim=dim, epochs=1)
    step, h = 2.0, 1e-6  # the layer and bias take the batch's sum over its full size of 16, here of two documents
    grad = lambda f, x: np.array([(f(x + h * d) - f(x - h * d)) / (2 * h) for d in np.eye(x.size).reshape(-1, *x.shape)]).reshape(x.shape)
    bias = np.zeros(2)
    new_out, new_bias = out - step * 2 / 16 * grad(lambda o: loss(emb, o, bias), out), bias - step * 2 / 16 * grad(lambda b: loss(emb, out, b), bias)
    new_emb = emb - step * 2 * grad(lambda e: loss(e, out, bias), emb)  # embeddings take each document's own step
    assert np.allclose(model.row_logit, new_emb @ (new_out[1] - new_out[0]), atol=1e-3) and abs(model.bias - (new_bias[1] - new_bias[0])) < 1e-3
    for t, r in zip(texts, rows):
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-(model.bias + model.row_logit[r].mean()))), abs=1e-6)
    long = "ab cd, Ef 12 " * 60_000  # several blocks
    parts = [p for p in quality_classifier.feature_rows(long)]
    assert len(parts) > 2 and abs(model.score(long) - model.score("ab cd, Ef 12 " * 300)) < 1e-2


def test_quality(spark):
    r = random.Random(10)
    make = {1: lambda: " ".join(word(r) for _ in range(40)), 0: lambda: " ".join(w for w in (word(r) for _ in range(15)) for _ in range(4)).upper()}
    rows = [(i, make[y](), y) for i in range(400) for y in [int(r.random() < 0.8)]]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (5000, None, 0), (rows[0][0], rows[0][2], 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.op10(docs, labels).collect()}
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 40 and sum(got[i].predicted == y for i, y in held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values()) and got[1000].score == got[1001].score
    none = quality_classifier.op10(docs, labels.limit(0)).collect()
    assert all(x.score == pytest.approx(1, abs=1e-6) for x in none)


def test_suffix_dedup_of_texts_over_a_block(spark):
    """A passage on both sides of a block's end, and a text longer than a block that repeats itself."""
    r = random.Random(17)
    passage = "".join(r.choice("abcdefghij ") for _ in range(700))
    filler = "".join(r.choice("klmnopqrstuvwxyz") for _ in range(suffix_dedup.TEXT_BLOCK - 350))
    texts = {1: passage, 2: filler + passage + "end", 3: filler[:1000]}
    got = by_id(suffix_dedup.dedup_suffixes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, got[3].n_removed) == (0, 700, 1, 1000)
    assert bytes(got[2].kept).decode() == filler + "end" and got[2].n_bytes == len(texts[2])


def test_columns_that_clash_pass_through(spark):
    text = "\n".join(f"{w} one two three four five six seven eight" for w in ("A", "B", "C", "D"))
    odd = ["_id", "_cut", "_at", "words", "bin", "task", "_carried_1", "component", "k1"]
    rows = [(i, text, *[f"{c}{i}" for c in odd], i) for i in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in odd) + ", n_removed long")
    for done, removed in ((line_dedup.dedup_lines(docs), 4), (substring_dedup.dedup_substrings(docs), 4)):
        got = {x.doc_id: x for x in done.collect()}
        assert got[2].text == "" and got[2].n_removed == removed and got[1].text == text
        assert all(got[i][c] == f"{c}{i}" for i in (1, 2) for c in odd)
    assert {(x.doc_id, x.kept) for x in minhash.near_duplicates(docs).collect()} == {(1, True), (2, False)}
    assert {x.doc_id for x in decontaminate.matches(docs, spark.createDataFrame([(1, text, "w")], "item_id long, text string, words string")).collect()} == {1, 2}


def test_written_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from entweave.llm import common

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(cluster)
    assert common.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: "hdfs:///shared/"))) == "hdfs:///shared"


def test_pipeline_of_empty_tables_and_further_columns(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    extra = ["_id", "_cut", "n_removed", "n_lines", "quality_score", "words", "item_id", "_carried_0"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    line = "one two three four five six seven"
    rows = [(i, f"{line} {i}\nshared a\nshared b\nshared c", 0, *[f"{c}{i}" for c in extra]) for i in (1, 2)] + [(3, None, None, *[None] * 8), (None, "x", 1, *["e"] * 8)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (p.quality_stage, p.line_stage, p.near_stage, p.leak_stage):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        kept = {x.doc_id: x for x in got.collect()}
        assert set(kept) == {1, 2, 3, None} and all(kept[i][c] == f"{c}{i}" for i in (1, 2) for c in extra)
        if stage is p.line_stage:
            assert kept[2].text == f"{line} 2" and kept[2].n_chars == len(kept[2].text)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_empty_tables(spark, empty):
    for df in (minhash.op2(empty), suffix_dedup.op3(empty), substring_dedup.op1(empty), line_dedup.op4(empty), packing.op7(empty), language_id.op9(empty)):
        assert df.count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.op6(empty, items).count() == 0
    assert url_filter.op5(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert topk.op8(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert quality_classifier.op10(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    import corpus_pipeline as p

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(texts[7].split()[:12]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = p.run(spark, str(tmp_path)).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    kept = {x.doc_id for x in p.near_stage(spark, base, str(tmp_path)).collect()}
    copies = minhash.near_duplicates(base, words=5).where("kept").select("doc_id").collect()
    assert kept == {x.doc_id for x in copies} and None in kept
    assert 7 not in {x.doc_id for x in p.leak_stage(spark, base, str(tmp_path)).collect()}
    left = {x.doc_id for x in p.line_stage(spark, base, str(tmp_path)).select("doc_id").collect()}
    gone = {i for i, x in by_id(line_dedup.op4(base)).items() if x.n_removed and x.n_removed == x.n_lines}
    assert 89 in gone and left == {*texts, None} - gone
