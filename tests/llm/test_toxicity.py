import random
import re

import numpy as np

from barloom.llm import toxicity


def corpus(n, toxic, seed=1):
    """Every ``toxic``-th document holds two of three telling words."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{rnd.randrange(200)}" for _ in range(30)]
        if k % toxic == 0:
            words[3:5] = rnd.sample(["idiot", "moron", "scum"], 2)
        rows.append((k, " ".join(words), int(k % toxic == 0)))
    return rows


def test_few_labels_have_terms(spark):
    rows = corpus(52, 9)  # 6 toxic
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int").drop("t")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).wanted


def test_rare_positives_and_labels_without_documents(spark):
    rows = corpus(4000, 100)  # 40 toxic
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int").drop("t")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + k, 1) for k in range(20_000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, examples=400)
    assert len(model.ids) == 400 and model.index.labels.sum() == 40 and model.index.prior == 41 / 4002
    assert model.index.lift == (3960 / 360 / 10, 0.1)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert found == {i: y for i, _, y in rows}


class Counted(np.ndarray):
    """Counts what is read of it."""

    read = 0

    def __getitem__(self, at):
        Counted.read += np.size(at)
        return np.asarray(self)[at]


def test_blocks_that_cannot_reach_the_best_are_not_read():
    # term 0 in six examples of each block: three alone and three beside another term in the first nine, beside two elsewhere
    vectors = []
    for k in range(32 * toxicity.BLOCK):
        block, at = divmod(k, toxicity.BLOCK)
        company = [1 + k % 97] if at >= 3 or block > 8 else []
        vectors.append(([0, *company, *([98 + k % 89] if block > 8 else [])], [1] * (1 + len(company) + (block > 8))) if at < 6 else ([187 + k % 83], [1]))
    index = toxicity.Neighbours.build(vectors, [0] * len(vectors), np.ones(270), 1.0, 0.5)
    index.weights = index.weights.view(Counted)
    Counted.read = 0
    ids, cosines = index.nearest([0], [1], k=25)
    assert ids.tolist() == [b * toxicity.BLOCK + n for b in range(9) for n in range(3)][:25] and np.allclose(cosines, 1)
    assert Counted.read == 9 * 6


def test_texts_together_equal_brute_force_of_each():
    rnd = np.random.default_rng(5)
    terms, often = 900, 1 / np.arange(1, 901)
    draw = lambda: np.unique(rnd.choice(terms, rnd.integers(0, 40), p=often / often.sum()))
    vectors = [(t.tolist(), rnd.integers(1, 4, len(t)).tolist()) for t in (draw() for _ in range(2500))]
    vectors[70:80] = [vectors[60]] * 10  # ties
    weight_of = rnd.uniform(0.1, 5, terms)
    index = toxicity.Neighbours.build(vectors, rnd.integers(0, 2, 2500).tolist(), weight_of, 2.0, 0.3)
    assert len(index.common) and len(index.most) and (np.diff(index.begin) < 20).any()
    dense = np.zeros((2500, terms))
    for k, (t, c) in enumerate(vectors):
        dense[k, t] = toxicity.unit(np.array(t, int), c, weight_of)
    found = list(index.each_nearest([(*v, ()) for v in vectors[:150]], 10))
    left_out = list(index.each_nearest([(*v, ()) for v in vectors[:150]], 10, range(150)))
    for k in range(150):
        cosine = dense @ dense[k]
        for without, (ids, cosines) in ((-1, found[k]), (k, left_out[k])):
            near = [n for n in np.lexsort((np.arange(2500), -np.round(cosine, 12))) if n != without and cosine[n] > 0][:10]
            assert ids.tolist() == near and np.allclose(cosines, cosine[near])
        # its company does not change a text's figures
        alone = index.nearest(*vectors[k], k=10)
        assert np.array_equal(alone[0], found[k][0]) and np.array_equal(alone[1], found[k][1])


def test_words_are_those_of_the_pattern():
    texts = ["Füße, Straße_1; İstanbul ΣΑΣ", "a\u0301b \u2028 \u00a0x\u200by", "你好，世界 😀 𝒳y", "plain ASCII\x1f_text", "\ufeffé", "é" * 5, "…", "٣ ² ½ Ⅷ", None, ""]
    texts += ["é" + "".join(map(chr, range(n, n + 4096))) for n in range(0, 0x10000, 4096) if n not in range(0xD000, 0xE000)]
    for text in texts:
        assert toxicity.words_of(text) == re.findall(r"\w+", (text or "").lower())
