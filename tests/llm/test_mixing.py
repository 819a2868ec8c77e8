import random

import pytest

from barloom.llm import mixing

TARGETS = {"source": 0.3, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.5}


def saturated_cells():
    """A hot source and scarce languages: many cells are taken whole. One source has no tokens."""
    rnd = random.Random(8)
    rows = []
    for s in range(40):
        for lang, part in (("en", 1.0), ("de", 0.3), ("fr", 0.03), ("es", 0.01)):
            for t in range(3):
                rows.append((len(rows), f"s{s}", lang, f"t{t}", 1 + int(1e6 * part / (s + 1) ** 1.3 * rnd.uniform(0.5, 1))))
    return rows + [(len(rows), "empty", "en", "t0", 0)]


def test_both_sizes_rake_saturated_cells_alike(spark):
    described = spark.createDataFrame(saturated_cells(), "doc_id long, source string, lang string, topic string, tokens long")
    local, frames = ({r["doc_id"]: r for r in mixing.mix(spark, described, TARGETS, local_cells=n).collect()} for n in (50_000, 1))
    assert sum(r["probability"] == 1 for r in local.values()) > 10
    for found in (local, frames):
        mass = sum(r["tokens"] * r["probability"] for r in found.values())
        assert mass == pytest.approx(0.5 * sum(r["tokens"] for r in found.values()), rel=1e-9)
        assert found[480]["probability"] == 0.5  # without tokens: the budget's share
    for i, r in local.items():
        assert frames[i]["probability"] == pytest.approx(r["probability"], abs=1e-6) and frames[i]["weight"] == pytest.approx(r["weight"], rel=1e-5)
        assert frames[i]["kept"] == r["kept"]


def test_a_rare_topic_gets_a_centre_however_rows_are_dealt(spark):
    rnd = random.Random(4)
    groups = [[f"{name}{k}" for k in range(40)] for name in ("a", "b", "c")]
    docs = [(k, " ".join(rnd.choice(groups[k % 2]) for _ in range(60))) for k in range(6000)]
    docs += [(10_000 + k, " ".join(rnd.choice(groups[2]) for _ in range(60))) for k in range(3)]  # one in 2001
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    centres = mixing.fit_topics(frame, topics=3)
    topic = {r["doc_id"]: r["topic"] for r in mixing.describe(frame, centres, keep=()).collect()}
    assert [len({topic[k] for k, _ in docs[i:6000:2]}) for i in (0, 1)] == [1, 1]
    assert len({topic[0], topic[1], topic[10_000]}) == 3 and len({topic[10_000 + k] for k in range(3)}) == 1
    assert (mixing.fit_topics(frame.repartition(7), topics=3) == centres).all()


def test_probabilities_equal_plain_raking(spark):
    """Raking and scaling once more, cell by cell with dicts and bisection."""
    rows = [r for r in saturated_cells() if r[4]]
    described = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    total = sum(r[4] for r in rows)
    share = {r[1:4]: r[4] / total for r in rows}
    fitted = dict(share)
    goals = []
    for d, name in enumerate(("source", "lang", "topic")):
        own = {}
        for cell, x in share.items():
            own[cell[d]] = own.get(cell[d], 0) + x
        want = TARGETS[name]
        raw = {v: want.get(v, x) if isinstance(want, dict) else x**want for v, x in own.items()}
        goals.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(mixing.ROUNDS):
        before = dict(fitted)
        for d, goal in enumerate(goals):
            now = {}
            for cell, x in fitted.items():
                now[cell[d]] = now.get(cell[d], 0) + x
            fitted = {cell: min(x * goal[cell[d]] / now[cell[d]], share[cell] / mixing.BUDGET) for cell, x in fitted.items()}
        if max(abs(fitted[c] - before[c]) for c in fitted) < mixing.CLOSE:
            break
    low, high = 0.0, 1e6
    for _ in range(200):
        x = (low + high) / 2
        mass = sum(share[c] * min(1, x * fitted[c] / share[c]) for c in share)
        low, high = (x, high) if mass < mixing.BUDGET else (low, x)
    found = mixing.mix(spark, described, TARGETS).collect()
    assert len(found) == len(rows)
    for r in found:
        cell = (r["source"], r["lang"], r["topic"])
        assert r["weight"] == pytest.approx(fitted[cell] / share[cell], rel=1e-6)
        assert r["probability"] == pytest.approx(min(1, low * fitted[cell] / share[cell]), rel=1e-6)
