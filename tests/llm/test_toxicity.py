import random
import zlib

import numpy as np

from vetolex.llm import toxicity
from vetolex.llm.queries import op3

BAD = {"en": ["idiotic", "idiots", "vileness"], "de": ["garstig", "garstige", "garstiges"]}
PLAIN = {"en": "the of and to in that house river walking stone paper", "de": "der die und den nicht haus fluss gehen stein papier"}


def corpus(n, seed=0):
    rnd = random.Random(seed)
    rows, toxic = [], []
    for i in range(n):
        lang = rnd.choice(["en", "de"])
        words = [rnd.choice(PLAIN[lang].split()) if rnd.random() < 0.7 else f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(5, 150))]
        bad = rnd.random() < 0.25
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(BAD[lang])
        rows.append((i, " ".join(words), "s", lang))
        toxic.append(int(bad))
    return rows, toxic


def test_learns_markers_and_generalises(spark, write_sf):
    rows, toxic = corpus(900)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    d = write_sf(rows, labels=labels)
    out = op3(spark, d).toPandas().set_index("doc_id")
    y = np.array(toxic)
    for i in out.index:
        assert out.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1)
    own = out[out.held_out]
    hit = (own.predicted == y[own.index]).mean()
    assert hit > 0.95 and (own.predicted == (own.score >= 0.7)).all()
    # a held-out label is never learned: turning it changes no score
    turned = spark.createDataFrame([(i, 1, (1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in enumerate(toxic)],
                                   "doc_id long, quality int, toxic int")
    again = op3(spark, write_sf([(r[0], r[1], "other", "xx") for r in rows], labels=turned)).toPandas().set_index("doc_id")
    assert np.allclose(again.score.sort_index(), out.score.sort_index())


def test_held_out_rows_of_the_tables(spark):
    from vetolex.llm.common import table
    d = "/root/testdata/sf0.1"
    out = op3(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    p, y = out.predicted == 1, out.toxic == 1
    assert len(out) == len(out.doc_id.unique()) and (p & y).sum() / y.sum() > 0.7 and (p & ~y).sum() / (~y).sum() < 0.03


def test_pieces_of_long_texts_pool_like_the_whole():
    model = toxicity.fit([b"a b c d", b"x y z"], np.array([1.0, 0.0]))
    rng = np.random.default_rng(0)
    model.embed = rng.standard_normal(model.embed.shape).astype(np.float32)
    model.weights[:] = rng.standard_normal(len(model.weights))
    ids = toxicity.WordIds().ids(b" ".join(b"w%d" % i for i in range(500)))
    assert np.isclose(model.logit(ids, step=37), model.logit(ids, step=10_000), atol=1e-4)


def test_language_guess():
    words = toxicity.WordIds()
    said = [toxicity.language(words.ids(t)) for t in (b"The house of the river", b"der Fluss und das Haus", b"les maisons est dans", b"el camino y la", b"", b"zz")]
    assert said == [0, 2, 1, 3, 4, 4]


def test_edges(spark, write_sf):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "word " * 50_000), (5, "the"), (5, "the"), (None, "x", None, None)]
    labels = spark.createDataFrame([(4, 1, 1), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        out = op3(spark, write_sf(rows, labels=table)).toPandas()
        assert len(out) == 7 and out.score.between(0, 1).all() and set(out.predicted) <= {0, 1}
    assert op3(spark, write_sf([], labels=labels)).count() == 0


def forward(embed, filters, weights, bias, raw):
    """The logit of one text, word by word and filter by filter, without numpy products of whole texts."""
    import xxhash
    mask = (1 << toxicity.BUCKET_BITS) - 1
    vectors = [sum(embed[(xxhash.xxh3_64_intdigest(w[:n], seed=i) & mask) + (i << toxicity.BUCKET_BITS)] for i, n in enumerate(toxicity.BEGINNINGS))
               for w in raw.split()]
    z, at = bias, 0
    for width, f in zip(toxicity.WIDTHS, filters):
        for c in range(toxicity.FILTERS):
            sums = [sum(float(vectors[i + j] @ f[j, :, c]) for j in range(width)) for i in range(len(vectors) - width + 1)]
            z += weights[at] * max([0.0, *sums])
            at += 1
    return z


def start_model(rng):
    return ((rng.standard_normal((len(toxicity.BEGINNINGS) << toxicity.BUCKET_BITS, toxicity.SIZE)) * 0.1).astype(np.float32),
            [(rng.standard_normal((w, toxicity.SIZE, toxicity.FILTERS)) / np.sqrt(w * toxicity.SIZE)).astype(np.float32) for w in toxicity.WIDTHS])


def test_forward_pass_against_loops():
    rng = np.random.default_rng(1)
    embed, filters = start_model(rng)
    weights = rng.standard_normal(len(toxicity.WIDTHS) * toxicity.FILTERS).astype(np.float32)
    model = toxicity.Model(embed, filters, weights, 0.25, np.zeros(len(toxicity.LANGUAGES) + 1))
    for n in (0, 1, 2, 3, 40):
        raw = " ".join(f"word{x}" for x in rng.integers(0, 30, n)).encode()
        want = forward(embed.astype(float), [f.astype(float) for f in filters], weights.astype(float), 0.25, raw)
        ids = toxicity.WordIds().ids(raw)
        for step in (1, 7, 4096):  # texts in pieces have the maxima of the whole
            assert abs(model.logit(ids, step) - want) < 1e-4


def test_gradient_of_one_step_against_differences(monkeypatch):
    """The first step moves a parameter by a known function of its gradient; that gradient is held against differences of the loss."""
    monkeypatch.setattr(toxicity, "STEPS", 1)
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(25)}" for _ in range(8)).encode() for _ in range(60)]
    y = np.array([i % 2 for i in range(60)])
    after = toxicity.fit(texts, y, seed=3)
    rng = np.random.default_rng(3)
    embed, filters = start_model(rng)
    train = rng.permutation(60)[12:]
    classes = [train[y[train] == k] for k in (1, 0)]
    batch = np.concatenate([c[rng.integers(0, len(c), toxicity.BATCH // 2)] for c in classes])
    params = {"embed": embed.astype(float), **{f"f{i}": f.astype(float) for i, f in enumerate(filters)}, "weights": np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS) + 0.1}
    moved = {"embed": after.embed, **{f"f{i}": f for i, f in enumerate(after.filters)}, "weights": after.weights}

    def loss():
        z = [forward(params["embed"], [params[f"f{i}"] for i in range(len(filters))], params["weights"], 0.0, texts[i]) for i in batch]
        return np.mean([np.log1p(np.exp(-v if y[i] else v)) for v, i in zip(z, batch)])

    checked = 0
    for name, rate in (("weights", 0.045), ("f0", 0.045), ("f1", 0.045), ("f2", 0.045), ("embed", 0.15)):
        p, r = params[name], (params[name] - moved[name].astype(float)) / rate
        implied = np.where(np.abs(r) < 1, np.sign(r) * 1e-3 * np.abs(r) / np.sqrt(np.maximum(1 - r * r, 1e-12)), np.nan)
        clear = np.argwhere((np.abs(r) > 0.2) & (np.abs(r) < 0.999))
        for at in map(tuple, clear[:: max(1, len(clear) // 3)][:3]):
            old, ends = p[at], []
            for eps in (1e-5, -1e-5):
                p[at] = old + eps
                ends.append(loss())
            p[at] = old
            slope = (ends[0] - ends[1]) / 2e-5
            assert abs(slope - implied[at]) < 0.03 * abs(slope) + 1e-5, (name, at, slope, implied[at])
            checked += 1
    assert checked >= 9
