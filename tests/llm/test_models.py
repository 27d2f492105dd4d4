"""The trained networks: slopes against differences, held-out accuracy, whole texts, edge cases; the pipeline on small tables."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import quality_cnn, toxicity_gru
from tracelake.llm.textbytes import column_bytes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DRAW = np.random.default_rng(0)
WORDS = ["".join(DRAW.choice(list("abcdefghij"), 5)) for _ in range(300)]


def good(n=60):
    return " ".join(DRAW.choice(WORDS, n))


def corpus(n):
    """Half of the rows good; the others shout, or hold an insult."""
    rows, labels = [], []
    for k in range(n):
        bad, rude = k % 2, k % 3 == 0
        text = good().upper().replace(" ", "!! ") if bad else good()
        if rude:
            text = text[:150] + " you zzinsult thing " + text[150:]
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, 1 - bad, int(rude)))
    return rows, labels


def slopes_agree(net, slopes, loss, names):
    for name in names:
        w, g = net.w[name], slopes[name]
        at = np.unravel_index(np.argsort(-np.abs(g).ravel())[:3], g.shape)
        for k in zip(*at, strict=True):
            old, step = w[k], 1e-2
            w[k] = old + step
            up = loss()
            w[k] = old - step
            down = loss()
            w[k] = old
            assert abs((up - down) / (2 * step) - g[k]) <= 0.08 * abs(g[k]) + 2e-3, name


def test_byte_network_slopes():
    texts, y = pa.array([good(40), good(80).upper(), "short", ""]), np.array([1, 0, 1, 0])
    net = quality_cnn.ByteNet(3)
    data, at = column_bytes(texts)

    def loss():
        p = net.score(data, at, net.tables())
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes_agree(net, net.slopes(data, at, y), loss, ["hidden", "bias", "mean", "top", "out", "bytes"])


def test_window_network_slopes():
    texts, y = pa.array([good(20), good(25)]), np.array([1, 0])  # one window each: the soft maximum is exact
    net = toxicity_gru.WindowNet(3)
    data, at = column_bytes(texts)
    net.w["word"][:] = 0  # dropout leaves no trace

    class Keep:
        def random(self, n):
            return np.zeros(n)

    def loss():
        p = net.score(data, at)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes_agree(net, net.slopes(data, at, y, Keep()), loss, ["look", "ask", "out", "bias", "in_f", "own_f", "bias_f", "in_b", "own_b", "gram", "word"])


def test_byte_network_by_plain_loops():
    """Every window of four bytes by itself, the overlapping chunks one by one."""
    net, w = quality_cnn.ByteNet(5), quality_cnn.ByteNet(5).w
    for text in ("", "ab", good(60), good(200).upper()):
        raw = list(text.encode() or b"\0") + [0, 0, 0]
        windows = [sum(w["bytes"][k, raw[i + k]].astype(float) for k in range(4)) for i in range(len(raw) - 3)]
        blocks = [np.max(windows[k : k + quality_cnn.BLOCK], axis=0) for k in range(0, len(windows), quality_cnn.BLOCK)]
        chunks = [np.maximum(x, blocks[min(k + 1, len(blocks) - 1)]) for k, x in enumerate(blocks)]
        hidden = [np.maximum(x @ w["hidden"] + w["bias"], 0) for x in chunks]
        z = np.mean(hidden, axis=0) @ w["mean"] + np.max(hidden, axis=0) @ w["top"] + w["out"][0]
        assert abs(net.score(*column_bytes(pa.array([text])), net.tables())[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_window_network_by_plain_loops():
    """Word by word: vectors, gates and attention of each window by themselves."""
    net = toxicity_gru.WindowNet(5)
    w, h = net.w, toxicity_gru.HIDDEN
    squash = lambda x: 1 / (1 + np.exp(-x))
    for text in ("one", good(20), "(" + good(90) + ") ???!!!!!!!!!!!!!!? ..........end.........."):
        spelled = []
        for raw in text.lower().split(" "):
            bare = raw.strip("".join(chr(k) for k in range(33, 127) if not chr(k).isalnum())) or raw[-1]
            _, _, word, gram, _ = toxicity_gru.vocabulary(*column_bytes(pa.array([bare])))
            spelled.append(w["word"][word[0]] + w["gram"][gram].sum(0) / np.sqrt(len(gram)))
        logits = []
        for start in range(0, max(1, len(spelled) - toxicity_gru.WINDOW + toxicity_gru.STRIDE), toxicity_gru.STRIDE):
            own = spelled[start : start + toxicity_gru.WINDOW]
            ways = []
            for way, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
                state, states = np.zeros(h), [None] * len(own)
                for t in order:
                    x, r = own[t] @ w[f"in_{way}"] + w[f"bias_{way}"], state @ w[f"own_{way}"]
                    update, reset = squash(x[:h] + r[:h]), squash(x[h : 2 * h] + r[h : 2 * h])
                    state = state + update * (np.tanh(x[2 * h :] + reset * r[2 * h :]) - state)
                    states[t] = state
                ways.append(np.array(states))
            both = np.concatenate(ways, 1)
            weight = np.exp(np.tanh(both @ w["look"]) @ w["ask"])
            logits.append((weight / weight.sum()) @ both @ w["out"] + w["bias"][0])
        assert abs(net.score(*column_bytes(pa.array([text])))[0] - squash(max(logits))) < 1e-5


def test_samples_are_limited_after_long_texts_are_left_out(spark):
    from tracelake.llm.training import labelled_sample

    docs = spark.createDataFrame([(k, "x" * (5000 if k % 2 else 10)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2 if k < 390 else 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    texts, y = labelled_sample(docs, labels, "quality", 5, 0, 3, 100)
    assert {len(x) for x in texts.to_pylist()} == {10} and sorted(y.tolist()) == [0, 0, 0, 1, 1, 1]


def test_samples_have_one_text_of_an_id(spark):
    from tracelake.llm.training import labelled_sample

    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text")).unionByName(spark.createDataFrame([(k, f"other {k}") for k in range(2, 40)], "doc_id long, text string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(1, 0)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", 5, 9, 100, 100)
    assert len(texts) == 39 and len(set(texts.to_pylist())) == 39 and y.sum() == 20
    assert "text 0" in texts.to_pylist()


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 56, 57, 1000])
    first, size, heads = toxicity_gru.windows(counts)
    base = np.cumsum(counts) - counts
    for k, n in enumerate(counts):
        own = range(heads[k], heads[k + 1])
        assert {i for w in own for i in range(first[w], first[w] + size[w])} == set(range(base[k], base[k] + n))


def test_byte_tables_equal_single_bytes():
    net = quality_cnn.ByteNet(1)
    texts = pa.array([good(300), "", "é", None, "x" * 1000])
    padded, bounds = quality_cnn._padded(*column_bytes(texts))
    assert np.allclose(net.pooled(padded, bounds)[0], net.pooled(padded, bounds, net.tables())[0], atol=1e-5)


@pytest.mark.parametrize("module, column, held", [(quality_cnn, "quality", 0), (toxicity_gru, "toxic", 1)])
def test_held_out_accuracy_and_edges(spark, module, column, held):
    rows, labels = corpus(360)
    edge = [(9001, None, None, None, None), (9002, "", "", "", 0), (9003, " \n ", "", "", 0), (9004, good(30000), "", "", 0), (None, "x", "", "", 0), (9001, None, None, None, None)]
    docs = spark.createDataFrame(rows + edge, DOCS)
    known = spark.createDataFrame([*labels, (5, None, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.scored(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows) + len(edge)
    truth = {i: (q, t)[column == "toxic"] for i, q, t in labels}
    seen = [r for r in got.collect() if r["doc_id"] in truth and r["held_out"]]
    assert len(seen) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in seen]) >= 0.95
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % module.FOLDS == held)
    assert module.scored(docs.limit(0), known).count() == 0
    only = module.scored(docs.filter("doc_id < 60"), known.filter("quality = 1 and toxic = 0"))
    assert {r["score"] for r in only.collect()} == {1.0 if column == "quality" else 0.0}
    assert {r["score"] for r in module.scored(docs.limit(5), known.limit(0)).collect()} == {0.5}


def test_toxicity_reads_to_the_end_of_long_texts(spark):
    rows, labels = corpus(360)
    net = toxicity_gru.train(pa.array([r[1] for r in rows]), np.array([x[2] for x in labels]))
    clean = good(5000)
    data, at = column_bytes(pa.array([clean, clean + " you zzinsult thing"]))
    low, high = net.score(data, at)
    assert low < 0.7 <= high


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    rows, labels = corpus(200)
    near = rows[0][1].split()
    item = "the quick brown fox jumps over one lazy dog near a river bank today"
    rows += [(1000, rows[0][1], "en", "s", 0), (1001, " ".join(near[:-1] + ["changed"]), "en", "t", 0), (1002, rows[2][1] + " " + item, "en", "t", 0), (1003, None, None, None, None), (None, good(), "en", None, 0)]
    for name, df in {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.count()
        path = str(tmp_path / name.replace("/", "").replace(" ", "_"))
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [x.split()[0] for x in DOCS.split(", ")]
        kept.append((before, {r["doc_id"] for r in docs.select("doc_id").collect()}))
    good_ids = {i for i, q, _ in labels if q}
    assert len(kept[0][1] & good_ids) >= 0.97 * len(good_ids) and len(kept[0][1] & (set(range(200)) - good_ids)) <= 5
    assert 0 in kept[1][1] and not {1000, 1001} & kept[1][1]
    assert kept[1][1] - kept[2][1] == {1002} & kept[1][1]
    out = pipeline.tokens(spark, docs, str(tmp_path)).orderBy("start").collect()
    assert len(out) == docs.count() and [r["doc_id"] is None or r["doc_id"] >= 0 for r in out]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    total = docs.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert total > 0


def test_pipeline_rows_without_or_with_shared_ids(spark):
    """Null and repeated ids: each row is a document of its own in the stages that link or count rows."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [good() for _ in range(60)]
    rows = [(None, t, "en", "s", 0) for t in texts[:30]] + [(7, t, "en", "s", 0) for t in texts[30:40]] + [(100 + k, t, "en", "t", 0) for k, t in enumerate(texts[40:])]
    copies = [(None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (7, texts[2], "en", "s", 0), (5, texts[40], "en", "t", 0), (None, None, None, None, None), (7, texts[35], "en", "s", 0)]
    docs = spark.createDataFrame(rows + copies, DOCS)
    left = pipeline.near_duplicates(spark, docs, "")
    found = left.collect()
    assert left.columns == docs.columns and sorted(r["text"] or "" for r in found) == sorted([*texts, ""])
    assert {r["text"]: r["doc_id"] for r in found} == {t: i for i, t, *_ in rows} | {texts[2]: 7, texts[40]: 5, None: None}

    many = [(None, good(3), "en", "s" if k % 4 else "t", k) for k in range(400)] + [(7, good(3), "en", "s", 1000 + k) for k in range(100)]
    docs = spark.createDataFrame(many, DOCS)
    times = dict.fromkeys((x[4] for x in many), 0) | {r["n_chars"]: r["count"] for r in pipeline.source_mix(spark, docs, "").groupBy("n_chars").count().collect()}
    # 1500 words by weights 1 and 2: "t" is capped at 3 times its 300, and 600 words are left for the 1200 of "s"
    assert {times[x[4]] for x in many if x[3] == "t"} == {3}
    taken = [times[x[4]] for x in many if x[3] == "s"]
    assert set(taken) == {0, 1} and sum(taken) == 200


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """What each stage keeps of what its predecessor kept, by plain Python; rows read from files, with further columns of clashing names."""
    pipeline, tokenizers = pytest.importorskip("corpus_pipeline"), pytest.importorskip("tokenizers")
    from tests.llm.test_text_operators import brute_classes, brute_tiling
    from tracelake.llm import decontaminate, mixing, quality_cnn

    extra = DOCS + ", row string, row_key long, file string, copies int, bucket string, i long"
    rows, labels = corpus(160)
    item = "seven lean cows walked slowly over the wide green hill and back again before noon"
    rows += [(None, rows[0][1], "en", "u", 0), (None, rows[0][1] + " x", "en", "u", 0), (4, good(), "en", "t", 0), (4, rows[6][1], "en", "t", 0), (300, good() + " " + item, "en", "t", 0), (301, item[:40] + good(), "en", "t", 0), (None, None, None, None, None), (302, "", "en", "t", 0)]
    for name, df in {
        "documents": spark.createDataFrame([(*r, "a", k, "b", 9, "c", k) for k, r in enumerate(rows)], extra).repartition(5),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    given = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    given[0] = docs.collect()
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1], 1):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == [x.split()[0] for x in extra.split(", ")]
        given[k] = docs.collect()
    of = lambda k: sorted(r["i"] for r in given[k])

    net = quality_cnn.fit(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    scores = {r["i"]: net.score(*column_bytes(pa.array([r["text"] or ""])), net.tables())[0] for r in given[0]}
    assert of(1) == sorted(i for i, s in scores.items() if s >= quality_cnn.THRESHOLD)

    classes, groups = {i: c for i, _, c in brute_classes([(r["i"], r["text"]) for r in given[1]])}, {}
    for r in given[1]:
        groups.setdefault(classes[r["i"]], []).append(r)
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert sorted(str((r["doc_id"], r["text"])) for r in given[2]) == sorted(str((x["doc_id"], x["text"])) for own in groups.values() for x in [min(own, key=order)])

    words = item.split()
    held = lambda text: brute_tiling(words, (text or "").lower().split())[1] >= decontaminate.THRESHOLD * len(words)
    assert of(3) == sorted(r["i"] for r in given[2] if not held(r["text"]))

    size = {r["i"]: len((r["text"] or "").split()) for r in given[3]}
    mixed = mixing.mix(spark.createDataFrame([(r["i"], r["text"], r["source"]) for r in given[3]], "doc_id long, text string, source string")).collect()
    taken, times = {}, {}
    for i in of(4):
        times[i] = times.get(i, 0) + 1
    assert set(times) <= set(of(3)) and max(times.values()) <= 3
    for r in given[3]:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["i"]] * times.get(r["i"], 0)
    for r in mixed:
        assert abs(taken[r["source"]] - r["target"]) <= max(0.03 * r["target"], 30)

    tokenizer = tokenizers.Tokenizer.from_file(pytest.importorskip("public_tokenizers").path(pipeline.TOKENIZER))
    want, start = [], 0
    for i, ids in sorted(((r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in given[4]), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes())):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, pipeline.tokens(spark, docs, str(tmp_path)).collect()), key=lambda x: x[1]) == want
