import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, jaccard_join, line_dedup
from barloom.llm.common import Scratch
from barloom.llm.components import connected_components
from barloom.llm.shingles import BLOCK, shingle_sets, word_hashes

UP = {c: c + 32 for c in range(65, 91)}


def test_exact_dedup(spark):
    rows = [(1, "Abc", 0), (2, "aBC", 0), (3, None, 0), (4, "", 0), (5, "É", 0), (6, "é", 0), (7, "x" * 100_000, 0), (2, "aBC", 0)] + [(100 + k, "hot", 0) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    found = sorted(tuple(r) for r in exact_dedup.dedup_exact(spark, docs, run_bits=4, fan_bits=2).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    norm = {i: (t or "").translate(UP) for i, t, _ in rows}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    expected = sorted((i, max(groups[norm[i]]), len(groups[norm[i]]), i == max(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, _, _ in rows)
    assert found == expected
    nameless = spark.createDataFrame([(None, "ABC", 0), (None, "new", 0)], "doc_id long, text string, kept int")
    stays = exact_dedup.dedup_exact(spark, docs.unionByName(nameless)).where("doc_id is null").select("keep_id", "kept").collect()
    assert sorted(map(tuple, stays), key=str) == [(2, False), (None, True)]
    smallest = exact_dedup.dedup_exact(spark, docs, keep="smallest").where("kept").select("doc_id").distinct()
    assert {r[0] for r in smallest.collect()} == {min(g) for g in groups.values()}
    assert exact_dedup.dedup_exact(spark, docs.limit(0)).count() == 0


def test_exact_dedup_sorts_and_merges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 700).alias("text"))
    each = exact_dedup.digests(docs, "doc_id", "text", 4)
    work = Scratch(spark, "test")
    runs = work.save(exact_dedup.first_runs(each, "doc_id"), "runs")
    # what is written is sorted: each file by run, then digest
    at = runs.select(F.input_file_name().alias("file"), "run", "text_sha256").collect()
    by_file = {}
    for file, run, digest in at:
        by_file.setdefault(file, []).append((run, digest))
    assert all(rows == sorted(set(rows)) for rows in by_file.values())
    level = exact_dedup.merged(exact_dedup.merged(runs, 2), 2)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") >= 2 and plan.count("Sort [run") >= 2 and "HashAggregate" not in plan
    found = {r["text_sha256"]: (r["run"], r["size"], r["low"], r["high"]) for r in level.collect()}
    assert found == {hashlib.sha256(f"t{k}".encode()).hexdigest(): (0, len(range(k, 4000, 700)), k, max(range(k, 4000, 700))) for k in range(700)}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 300 + k) for k in range(30)]
    work = Scratch(spark, "test")
    found = {r["node"]: r["component"] for r in connected_components(work, spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert found == {x: find(x) for x in list(root)}
    assert connected_components(work, spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_few_edges_and_many_give_the_same_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(200, 300 + k) for k in range(20)]
    frame, work = spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")
    few, many = ({tuple(r) for r in connected_components(work, frame, f"t{n}", few=n).collect()} for n in (1000, 0))
    assert few == many and few


def words_of(text):
    return (text or "").encode().lower().split()


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = words_of(t)
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def plain_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_word_hashes_do_not_depend_on_place():
    data = b"one two\x0bthree  one\n" + b"x" * (BLOCK + 10) + b" two " + b"y z " * (BLOCK // 2)
    hashes, starts = word_hashes(data)
    words = data.split()
    assert len(hashes) == len(words) and hashes[0] == hashes[3] and hashes[1] == hashes[5]
    assert len({int(h) for h in hashes}) == len(set(words))
    assert [data[s : s + len(w)] for s, w in zip(starts[:2000], words)] == words[:2000]
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n ")[0]) == 0
    # words alike but for one byte, padding or length, at every length
    many = [b"a" * n + x for n in range(80) for x in (b"", b"\0", b"\0\0", b"b", b"\xff")]
    many = sorted({w for w in many if w})
    assert len(set(word_hashes(b" ".join(many))[0].tolist())) == len(many)
    assert not set(word_hashes(b" ".join(many))[0].tolist()) & set(word_hashes(b" ".join(many), seed=1)[0].tolist())


def test_words_of_like_structure_differ(spark):
    """Thue-Morse words and their mirrors have one polynomial hash modulo a power of two, whatever its base."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(spark, docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_near_copies_make_few_edges(spark, monkeypatch):
    """A group of near copies shares many lists; a pass compares each of its sets with one other."""
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rnd.sample(range(300), 3):
            copy[at] = f"x{k}-{at}"
        texts.append((k, " ".join(copy)))
    made = []
    partners = jaccard_join._partners
    monkeypatch.setattr(jaccard_join, "_partners", lambda *x: made.append(partners(*x).count()) or partners(*x))
    found = jaccard_join.link_components(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    assert made and max(made) <= 120


def test_written_tables_go_when_read(spark, monkeypatch):
    """A pass keeps its links and compared pairs; hash ranges, lists and components of earlier ones are deleted."""
    import os

    saved, held = [], []
    save = Scratch.save

    def noted(work, df, name):
        out = save(work, df, name)
        saved.append(name)
        held.append({x for x in os.listdir(work.root.removeprefix("file://")) if not x.startswith(".")})
        return out

    monkeypatch.setattr(Scratch, "save", noted)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    texts = [(k, " ".join(f"x{k}" if rnd.random() < 0.005 else w for w in base)) for k in range(60)]
    jaccard_join.link_components(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert "gathered" in saved and "gathered" not in held[-1]
    assert all(sum(x.startswith("in-") for x in h) <= 2 and sum(x.startswith(("open-", "offers-", "ends-")) for x in h) <= 3 for h in held)


def test_rare_links_in_common_lists_take_few_passes(spark, monkeypatch):
    """Sets of common passages share long lists in which few pairs link; passes end once they close little."""
    saved = []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda work, df, name: saved.append(name) or save(work, df, name))
    rnd = random.Random(5)
    passages = [" ".join(f"p{p}-{k}" for k in range(60)) for p in range(15)]
    texts = {k: " ".join(passages[p] for p in sorted(rnd.sample(range(15), 10))) for k in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.link_components(spark, docs).collect()}
    assert found == plain_components(plain_sets(texts))
    assert 1 < len(set(found.values())) < 140
    assert sum(x.startswith("pairs-") for x in saved) <= 4


def test_a_pair_meets_in_its_first_list(spark, monkeypatch):
    """Sets of different components that share many lists are compared in one of them."""
    made = []
    meet = jaccard_join._meet
    monkeypatch.setattr(jaccard_join, "_meet", lambda *x: made.append(meet(*x).count()) or meet(*x))
    words = {f"w{w}": 0 for w in range(jaccard_join.WORDS)}
    # set 5 has a list of its own before all others, set 4 starts late
    rows = [dict(key=k, rep=r, n=100, at=k, component=r, **words) for r in range(6) for k in range(12 if r == 4 else 0, 20)]
    rows.append(dict(key=99, rep=5, n=100, at=0, component=5, **words))
    rest = spark.createDataFrame(rows, "key long, rep long, n long, at long, component long, " + ", ".join(f"{w} long" for w in words))
    work = jaccard_join.Scratch(spark, "test")
    for crowd in (512, 0):
        monkeypatch.setattr(jaccard_join, "CROWD", crowd)
        made.clear()
        met = jaccard_join._met(work, rest, 80)
        assert sorted(map(tuple, met.collect())) == [(a, b) for a in range(6) for b in range(a + 1, 6) if 4 not in (a, b)]
        assert sum(made) == 10


def test_one_id_with_two_texts_links_by_both(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(7, a), (7, b), (3, a), (9, b), (9, b), (5, "else"), (5, None)], "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.link_components(spark, docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert found == [(3, 16, 3), (5, 0, 5), (5, 1, 5), (7, 16, 3), (7, 16, 3), (9, 16, 3), (9, 16, 3)]


def test_jaccard_join_of_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short")], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(spark, docs).collect()}
    assert found == {1: (399_996, 1), 2: (399_997, 1), 3: (1, 3)}


def test_shingle_sets_count_like_plain_ones():
    texts = {0: None, 1: "", 2: " \n ", 3: "a", 4: "A b c d", 5: "a b c d e f a b c d e f", 6: "é É x y z   q"}
    assert [len(s) for s in shingle_sets(texts.values())] == [len(s) for s in plain_sets(texts).values()]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", 3)  # so that every way of meeting is taken
    monkeypatch.setattr(jaccard_join, "WORTH", 0.25 if seed == 1 else 0)
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts, at = {}, 0
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    for _ in range(30):
        size = rnd.choice([1, 3, 4, 5, 6, 8, 9, 10, 12, 14, 18, 30, 60])
        base = [rnd.choice(vocabulary) for _ in range(size)] + (passage if rnd.random() < 0.4 else [])
        for _ in range(rnd.choice([1, 1, 2, 4, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                k = rnd.randrange(len(copy) + 1)
                if rnd.random() < 0.5:
                    copy[k:k] = [rnd.choice(vocabulary)]
                elif k < len(copy) and len(copy) > 1:
                    copy[k] = rnd.choice(vocabulary)
            texts[at] = " ".join(copy)
            at += 1
    texts |= {900: None, 901: "", 902: "  ", 903: texts[0].upper()}
    rows = [(i, t, i) for i, t in texts.items()]
    rnd.shuffle(rows)
    rows.append(rows[0])  # a repeated row
    nameless = spark.createDataFrame([(None, texts[0], 1)], "doc_id long, text string, n long")
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    found = jaccard_join.link_components(spark, docs.unionByName(nameless)).collect()
    assert len(found) == len(rows)
    sets = plain_sets(texts)
    expected = plain_components(sets)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(sets[i]), expected[i]) for i in texts}


def test_jaccard_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.link_components(spark, docs).count() == 0


def plain_line_dedup(texts, words):
    """Deletes every line that some run of ``words`` words covers whose lines occur earlier as a run."""
    lines = {d: [x for line in (t or "").split("\n") if (x := line.strip())] for d, t in texts.items()}
    seen, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        for i in range(len(lines[d])):
            for j in range(i + 1, len(lines[d]) + 1):
                run = tuple(lines[d][i:j])
                if sum(len(x.split()) for x in run) >= words:
                    if run in seen:
                        gone[d].update(range(i, j))
                    else:
                        seen[run] = (d, i)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    pool = [" ".join(f"x{rnd.randrange(50)}" for _ in range(rnd.choice([1, 2, 4, 7]))) for _ in range(12)]
    run = [rnd.choice(pool) for _ in range(6)]
    texts = {}
    for d in range(25):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            a = rnd.randrange(len(run))
            parts += run[a : a + rnd.randrange(1, 6)] if rnd.random() < 0.6 else [rnd.choice(pool), "", f" only here {d} "]
        texts[d] = "\n".join(parts)
    texts |= {50: None, 51: "", 52: "\n\n", 53: "same same same\n" * 9}
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, i int")
    found = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark, docs, words=9).collect()}
    expected = plain_line_dedup(texts, 9)
    assert {d: set(r["removed"]) for d, r in found.items()} == expected
    assert found[50]["text"] is None and found[51]["text"] == "" and found[52]["text"] == "\n\n"
    everything = {x.strip() for t in texts.values() for x in (t or "").split("\n")}
    assert {x.strip() for r in found.values() for x in (r["text"] or "").split("\n")} == everything


def test_line_dedup_of_repeated_ids_and_long_texts(spark):
    passage = "\n".join(f"line {k} of the passage" for k in range(30))
    long = "\n".join(f"only {k}" for k in range(60_000))
    rows = [(1, passage), (2, "own words\n" + passage), (2, passage + "\nmore"), (3, long), (3, long), (4, long + "\nend"), (None, passage), (None, passage + "\nno id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["n_lines"], len(r["removed"]), r["text"]) for r in line_dedup.dedup_lines(spark, docs).collect()), key=str)
    # of texts without an id one stays whole; its copies, and those of all with an id, go
    assert sum(passage in t for _, _, _, t in found) == 1 and next(t for i, _, _, t in found if passage in t) in (passage, passage + "\nno id")
    assert sorted(t for i, _, _, t in found if i == 2) == ["more", "own words"] and [t for i, _, _, t in found if i == 1] == [""]
    assert [(n, k) for i, n, k, _ in found if i in (3, 4)] == [(60_000, 0), (60_000, 0), (60_001, 60_000)]


def test_line_dedup_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(spark, docs).count() == 0
