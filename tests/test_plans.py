import math
from collections import Counter

from pyspark.sql import functions as F

from tests import python_rules as R
from vetolex.operators import clean as C
from vetolex.operators import model as M
from vetolex.operators import text as T
from vetolex.operators.split import stratified_split
from vetolex.operators.topk import top_k_per_group
from vetolex.sources.tables import posts, posts_all


def test_split_matches_brute_force(spark, small_dir):
    import hashlib
    p = posts(spark, small_dir).select("id", "label")
    got = {r.id: r.split for r in stratified_split(p).collect()}
    rows = [(r.id, r.label) for r in p.collect()]
    exp = {}
    for lab in {l for _, l in rows}:
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, l in rows if l == lab)
        n_val = round(0.2 * len(ids) + 1e-12)
        for k, (_, i) in enumerate(ids):
            exp[i] = "val" if k < n_val else "train"
    assert got == exp


def test_reset_index_contiguous(spark, small_dir):
    p = posts_all(spark, small_dir).select("id")
    rows = C.reset_index(p).collect()
    assert sorted(r.row_index for r in rows) == list(range(len(rows)))
    assert [r.id for r in sorted(rows, key=lambda r: r.row_index)] == sorted(r.id for r in rows)


def test_top_k_per_group_brute_force(spark):
    data = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(500)]
    df = spark.createDataFrame(data, "id long, g string")
    got = {(r.g, r.id) for r in top_k_per_group(df, ["g"], [F.col("id")], 3).collect()}
    exp = set()
    for g in {g for _, g in data}:
        exp |= {(g, i) for i in sorted(i for i, gg in data if gg == g)[:3]}
    assert got == exp


def test_tfidf_matches_brute_force(spark, small_dir):
    docs = posts_all(spark, small_dir)
    tf, vocab, n = T.fit_tfidf(docs)
    got = {(r.id, r.term): r.value for r in T.tfidf_transform(tf, vocab).collect()}
    texts = {r.id: r.text for r in docs.collect()}
    grams = {i: Counter(R.ngrams(R.tokens(t))) for i, t in texts.items()}
    dfreq = Counter(g for c in grams.values() for g in c)
    idf = {g: math.log((1 + n) / (1 + d)) + 1 for g, d in dfreq.items() if 2 <= d <= math.floor(0.95 * n)}
    for i, c in grams.items():
        x = {g: tf_ * idf[g] for g, tf_ in c.items() if g in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        for g, v in x.items():
            assert abs(got[(i, g)] - v / norm) < 1e-9
    assert len(got) == sum(1 for c in grams.values() for g in c if g in idf)


def _brute_score(text, model_rows, intercept):
    w = {t: (i, idf, c) for t, i, idf, c in model_rows if idf is not None}
    nums = {t: (i, c) for t, i, idf, c in model_rows if idf is None}
    e_pos, e_neg, w_pos, w_neg = R.features(text)
    cnt = Counter(g for g in R.ngrams(R.tokens(text)) if g in w)
    x = {g: k * w[g][1] for g, k in cnt.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    logit = (sum(x[g] * w[g][2] for g in x) / norm if norm else 0.0)
    vals = dict(zip(("emoji_pos_count", "emoji_neg_count", "word_pos_count", "word_neg_count"), (e_pos, e_neg, w_pos, w_neg)))
    logit += sum(vals[k] * nums[k][1] for k in nums) + intercept
    p1 = 1 / (1 + math.exp(-logit))
    # in single emojis: 0.2 * 10 d / (10 s + 1)
    neg, pos = e_neg // 10, e_pos // 10
    fired = 0 < neg >= pos and (pos > 0 or w_pos < 2)
    vconf = round(0.75 + 2 * (neg - pos) / (10 * (neg + pos) + 1), 4)
    pred = 0 if fired else int(logit > 0)
    conf = vconf if fired else max(p1, 1 - p1)
    active = [(w[g][0], g, round(w[g][2], 4)) for g in cnt] + [(nums[k][0], k, round(nums[k][1], 4)) for k in nums if vals[k] != 0]
    active.sort(key=lambda a: a[0])
    drivers = sorted(active, key=lambda a: abs(a[2]), reverse=True)
    if fired:
        veto_d = [d for d in drivers if d[1] == "emoji_neg_count"]
        drivers = veto_d + [d for d in drivers if d[1] != "emoji_neg_count"]
    return pred, round(conf, 4), [d[1] for d in drivers[:3]], fired


def test_predict_sentiment_brute_force(spark, small_dir):
    model = M.fixed_model(spark)
    extra = ["", "   ", "!!!", "i love having bugs 😭", "love hate love 😊", "the the of the 😭😭 great"]
    p = posts(spark, small_dir).select("id", "text").unionByName(
        spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(extra)], "id long, text string"))
    out = {r.id: r for r in M.predict_sentiment(p, model).collect()}
    texts = {r.id: r.text for r in p.collect()}
    rows = M.fixed_weight_rows()
    for i, t in texts.items():
        pred, conf, drivers, fired = _brute_score(t, rows, M.FIXED_INTERCEPT)
        r = out[i]
        assert r.prediction_int == pred and r.veto_applied == fired, t[-40:]
        assert abs(r.confidence - conf) < 1e-9
        assert [d.token for d in r.top_drivers] == drivers, t[-40:]


def test_stream_equals_batch(spark, small_dir, tmp_path):
    from vetolex.sources.tables import read_table, table_path
    from vetolex.streaming.score import run_stream_score, score_batch
    model = M.fixed_model(spark)
    streamed = run_stream_score(spark, table_path(small_dir, "conversations"), str(tmp_path / "sink"),
                                str(tmp_path / "ckpt"), model).drop("epoch", "timestamp")
    batch = score_batch(read_table(spark, small_dir, "conversations"), model).drop("timestamp")
    cols = sorted(batch.columns)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_health_report_shape(spark):
    from vetolex.operators.certify import health_report
    checks = spark.createDataFrame([("binary_labels", 0, True), ("veto_confidence_range", 2, False),
                                    ("word_guard", 1, False), ("misc", 0, True)],
                                   "check string, violations bigint, passed boolean")
    r = health_report(checks).first()
    assert r.status == "FAILED" and r.summary.total == 4 and r.summary.failed == 2
    assert dict(r.failed_by_category) == {"emoji_veto": ["veto_confidence_range"], "lexicon_integrity": ["word_guard"]}
