"""Small cases of the operators that search or learn: 1, 8, 10, and the pipeline."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeloom.llm import components, line_dedup, near_dedup, quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance(a: str, b: str) -> int:
    # What both begin or end with does not count.
    head = len(os.path.commonprefix([a, b]))
    a, b = a[head:], b[head:]
    tail = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within():
    rnd = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in "ab")
        for tau in (0, 1, 2, 3):
            assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau), (a, b, tau)


def lines_by_hand(docs, tau=line_dedup.TAU, least=line_dedup.MIN_CHARS):
    at = [((float("inf") if i is None else i, n), line) for i, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
    first = {}
    for place, line in at:
        first[line] = min(first.get(line, place), place)
    close = {}
    for a in first:
        if len(a) >= least:
            close[a] = any(len(b) >= least and first[b] < first[a] and abs(len(a) - len(b)) <= tau and distance(a, b) <= tau for b in first)
    out = []
    for i, t in docs:
        key = float("inf") if i is None else i
        mine = [(n, line) for n, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
        gone = [n for n, line in mine if first[line] < (key, n) or close.get(line)]
        out.append((str(i), len(mine), gone))
    return sorted(out)


@pytest.mark.parametrize(("per_line", "crowded_chunk", "crowd"), [(16, 256, 50_000), (1, 256, 50_000), (16, 8, 50_000), (16, 256, 3)])
def test_line_dedup(spark, per_line, crowded_chunk, crowd, monkeypatch):
    """Pairs and blocks; keys that a chunk finds crowded, and such that a task gives up for crowded."""
    monkeypatch.setattr(line_dedup, "PAIRS_PER_LINE", per_line)
    monkeypatch.setattr(line_dedup, "CROWDED_CHUNK", crowded_chunk)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    rnd = random.Random(4)
    pool = ["Subscribe to our newsletter number {} today and every day", "A rather short line {}", "…öäü naïve café line with accents {}"]
    docs = [(None, "the line of a document without a name"), (950, None), (951, ""), (952, "\n \n"), (953, "x\nx\nx"), (954, "y" * 20_000 + "\n" + "y" * 19_999 + "z")]
    for i in range(60):
        lines = [rnd.choice(pool).format(rnd.randint(0, 300)) for _ in range(rnd.randint(1, 3))]
        lines.append("".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(18, 40))))
        if rnd.random() < 0.4 and len(docs) > 8:
            x = list(rnd.choice(docs[8:])[1].split("\n")[-1])
            for _ in range(rnd.randint(1, 3)):
                x[rnd.randrange(len(x))] = rnd.choice(["", "q", "qq"])
            lines.append("".join(x))
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, line int, key string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_lines"], list(r["removed_lines"])) for r in line_dedup.line_dedup(df).collect())
    assert got == lines_by_hand(docs)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df, line_dedup.line_dedup(df)).collect()}
    assert kept[953] == "x" and kept[950] is None and kept[954] == "y" * 20_000
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
    clashing = df.withColumnsRenamed({"line": "of0", "key": "removed_lines"})
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_lines(clashing, line_dedup.line_dedup(clashing)).collect()} == kept


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)]
    up = {n: n for p in links for n in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {n: root(n) for n in up if any(n in p and p[0] != p[1] for p in links)}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in components.contract(df).collect()} == want
    early = components.contract(df.filter("a % 2 = 0"))
    assert {r["node"]: r["component"] for r in components.contract(df.filter("a % 2 = 1"), early).collect()} == want


def near_by_hand(docs):
    sets = []
    for i, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((str(i), len(s), str(root(i)) if i is not None else "None", i is None or root(i) == i) for i, s in sets)


@pytest.mark.parametrize("small", [8, 2])
def test_near_duplicates(spark, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(3000)}"
    docs = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "two one"), (None, "one two"), (906, "long " * 20_000), (907, "long " * 19_000)]
    for g in range(12):
        base = [word() for _ in range(rnd.randint(8, 150))]
        for k in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = word()
            docs.append((g * 40 + k, " ".join(copy)))
    docs.append(docs[-1])
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n int").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == near_by_hand(docs)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_members_of_many_buckets_meet_their_component_once(spark, monkeypatch):
    """Pipeline, round 3: a row a member joins the labels, however many buckets it is in; counts of buckets and components stay right."""
    monkeypatch.setattr(near_dedup, "COUNT_ROWS", 64)
    rows = [(bucket, i) for bucket in range(20) for i in range(60) if (bucket + i) % 3]
    members, own = spark.createDataFrame(rows, "bucket long, id long"), spark.createDataFrame([(i, i % 2) for i in range(40)], "n long, c long")
    want = Counter((bucket, i % 2 if i < 40 else i) for bucket, i in rows)
    made = near_dedup._component_counts(members, own)
    assert {(r["bucket"], r["c"]): r["n"] for r in made.groupBy("bucket", "c").agg(F.sum("n").alias("n")).collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join LeftOuter") < plan.index("collect_set")


def test_pipeline_drops_near_copies_from_80_percent(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(21)
    word = lambda: f"w{rnd.randrange(5000)}"
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    docs = []
    for g in range(40):
        base = [word() for _ in range(100)]
        # Common shingles of 96: 87 (similarity 0.83), 86 (0.81), 85 (0.79).
        for k, places in enumerate(((), ((50, 3), (50, 70), (20, 50, 99))[g % 3])):
            copy = list(base)
            for x in places:
                copy[x] = f"new{x}"
            docs.append((2 * g + k, copy))
    sets = [shingles(t) for _, t in docs]
    links = lambda percent: {k + 1 for k in range(0, 80, 2) if 100 * len(sets[k] & sets[k + 1]) >= percent * len(sets[k] | sets[k + 1])}
    assert len(links(80)) == 27 and not links(85)
    docs += [(100, "a b c d e f g h".split()), (101, "a b c d e f g h i".split())]  # 4 of 5 shingles
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string").repartition(3)
    left = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, df, "").collect()}
    assert left == {i for i, _ in docs} - links(80) - {101}
    assert near_dedup.near_duplicates(df).filter("NOT kept").count() == 0
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(df, percent=100)


def test_bands_follow_the_percentage():
    assert (near_dedup._band(85), near_dedup._band(80)) == (8, 6)
    for percent in (50, 70, 80, 85, 95):
        width = near_dedup._band(percent)
        assert near_dedup.REGISTERS % width == 0 and (1 - (percent / 100) ** width) ** (near_dedup.REGISTERS // width) <= near_dedup.MISS


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for n, common in ((40, 30), (600, 540), (600, 300)):
        truth = common / (2 * n - common)
        found = []
        for _ in range(20):
            u = rng.integers(0, 2**63, 2 * n - common, dtype=np.uint64)
            k = near_dedup.registers(np.concatenate([np.sort(u[:n]), np.sort(u[n - common :])]), np.array([0, n, 2 * n]))
            found.append(near_dedup.estimate(k[:1], k[1:], np.array([float(n)]), np.array([float(n)]))[0])
        assert abs(np.mean(found) - truth) < 0.03


def test_sketches_merge():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    a, b = x[:500], x[300:]
    k = near_dedup.registers(np.concatenate([a, b, x]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + len(x)]))
    assert (np.maximum(k[0], k[1]) == k[2]).all()


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(3)
    vocabulary = [f"word{k}" for k in range(400)]
    docs, labels = [], []
    for i in range(600):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 80))]
        kind = i % 4
        if kind == 0:
            text[rnd.randrange(len(text))] = rnd.choice(["vilest", "vileness"])
        elif kind == 1:
            text = [rnd.choice(vocabulary).upper() + "!!"] * len(text)
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    docs += [(700, None), (701, ""), (None, "word1 word2"), (702, "word3 " * 50_000)]
    labels += [(None, 1, 0), (5000, 1, 0), (1, None, None)]
    return spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, g int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_marks_depend_on_their_own_text_only():
    """Features of a text are the same alone, before and behind any other, and in any batch."""
    texts = ["", "ABC DEF", " ", "abc | def!!", None, "", "!!! @@ ##", "\t\n", "Ünï CODE code code", "x", ""]
    read = lambda rows: [sorted(b[r == i].tolist()) for _, n, r, b in quality.features(pa.array(rows, pa.string())) for i in range(n)]
    alone = [read([t])[0] for t in texts]
    rnd = random.Random(3)
    for _ in range(20):
        order = rnd.sample(range(len(texts)), len(texts))
        assert read([texts[i] for i in order]) == [alone[i] for i in order]
    assert alone[0] == alone[2] == alone[4] == alone[7]


def logloss(weights, thresholds, rows, size, ridge, n):
    """The weighted loss that fit() takes the gradient of, straight from its definition."""
    total = 0.0
    for g, x in rows:
        at = weights[x].sum()
        edges = [0.0, *(1 / (1 + np.exp(-(t - at))) for t in thresholds), 1.0]
        total -= size[g] * np.log(max(edges[g + 1] - edges[g], 1e-12))
    return total / n + ridge / 2 * (weights**2).sum()


def test_quality_gradient():
    """The gradient of a part against finite differences of the loss."""
    rnd = np.random.default_rng(4)
    d, rows = 6, [(int(g), rnd.choice(6, rnd.integers(0, 5), replace=False)) for g in rnd.integers(0, 3, 40)]
    w, t, size = rnd.normal(0, 0.5, d), np.array([-0.4, 0.7]), np.array([1.5, 1.0, 0.7])
    got = quality.gradient(np.array([g for g, _ in rows]), np.concatenate([[0], np.cumsum([len(x) for _, x in rows])]), np.concatenate([x for _, x in rows]).astype(int), w, t, size)
    both = np.concatenate([w, t])
    for k in range(d + 2):
        up, down = both.copy(), both.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        want = (logloss(up[:d], up[d:], rows, size, 0, 1) - logloss(down[:d], down[d:], rows, size, 0, 1)) / 2e-5
        assert abs(got[k] - want) < 1e-4 * max(1, abs(want)), k


def test_fit_agrees_with_a_plain_optimiser(spark):
    """The fit on Spark reaches the loss that plain gradient steps on the same design reach."""
    rnd = random.Random(8)
    telling = {0: ["vile", "awful", "hate"], 1: ["click", "buy", "now"], 2: ["river", "meadow", "stone"]}
    rows, labels = [], []
    for n in range(240):
        g = n % 3
        rows.append((n, " ".join(rnd.choice(telling[g if rnd.random() < 0.8 else rnd.randrange(3)]) for _ in range(8))))
        labels.append((n, int(g == 2), int(g == 0)))
    docs, rated = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, rated)
    place = {b: k for k, b in enumerate(model.buckets.tolist())}
    column = pa.array([t for _, t in rows])
    design: list[list[int]] = [[] for _ in rows]
    for first, _, r, b in quality.features(column):
        for row, bucket in zip(r.tolist(), b.tolist(), strict=True):
            if bucket in place:
                design[first + row].append(place[bucket])
    g, size = np.array([n % 3 for n in range(240)]), np.ones(3)
    cuts, x = np.concatenate([[0], np.cumsum([len(d) for d in design])]), np.concatenate([np.array(d, dtype=int) for d in design])
    data = [(n % 3, np.array(d, dtype=int)) for n, d in enumerate(design)]
    w, t = np.zeros(len(place)), np.array([-0.7, 0.7])
    for _ in range(3000):
        step = quality.gradient(g, cuts, x, w, t, size) / len(rows)
        w, t = w - 0.5 * (step[: len(w)] + quality.RIDGE * w), t - 0.5 * step[len(w) :]
    reached, best = (logloss(a, b, data, size, quality.RIDGE, len(rows)) for a, b in ((model.weights, model.thresholds), (w, t)))
    assert best <= reached < best + 0.02 * abs(best) + 0.005


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_quality_held_out_shares(spark):
    """On the labels left out of a fit: few toxic and junk documents pass, nearly all good ones do."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0
    told = labels.filter(held).withColumn("g", quality.grade(F.col("quality"), F.col("toxic"))).select("doc_id", "g")
    texts = docs.join(told, F.col("id") == F.col("doc_id")).select("id", F.coalesce("text", F.lit("")).alias("text"))
    passed = quality.score(texts, quality.fit(docs, labels.filter(~held))).join(told, "doc_id").groupBy("g").agg(F.avg(F.col("selected").cast("double")).alias("share")).collect()
    share = {r["g"]: r["share"] for r in passed}
    assert share[0] <= 0.02 and share[1] <= 0.15 and share[2] >= 0.95, share


def test_quality_held_out(rated):
    docs, labels = rated
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i in range(0, 600, 3):
        assert rows[i]["selected"] == (i % 4 > 1), (i, rows[i])
    assert all(0 <= r["expected_grade"] <= 2 for r in rows.values())
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["selected"]}


def test_quality_without_labels(rated):
    docs, labels = rated
    assert quality.classify(docs, labels.limit(0)).count() == docs.count()
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(8)
    words = [f"t{k}" for k in range(2000)]
    body = lambda n: [rnd.choice(words) for _ in range(n)]
    item = body(30)
    docs = []
    for i in range(200):
        docs.append((i, " ".join(body(60))))
    docs[150] = (150, docs[10][1].replace(" ", "  "))
    near = docs[20][1].split(" ")
    near[58] = "changed"
    docs[151] = (151, " ".join(near))
    docs[152] = (152, " ".join([*body(5), *item]))
    for i in range(160, 200):
        docs[i] = (i, docs[i][1] + " vilest")
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 160)) for i in range(0, 200, 2) if i not in (150, 152)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert left == set(range(160)) - {10, 151, 152}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "best-fit packing"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Null, empty, blank and repeated rows, null identifiers, columns with the helpers' names, and empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b  c d e f g h"), (None, "x y z"), (None, None), (3, None), (4, ""), (5, " \n"), (6, "x" * 50_000)]
    named = "doc_id long, text string, lang string, source string, n_chars long, row string, own int, drop_id int, bad_id int, sha string, nth int"
    docs = spark.createDataFrame([(i, t, None, "s", None, "r", 0, 1, 2, "s", 3) for i, t in rows], named)
    empty = lambda columns: spark.createDataFrame([], columns)
    empty("doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    empty("item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert kept["exact dedup"] == sorted([(2, "a b  c d e f g h"), (None, "x y z"), (5, " \n"), (6, "x" * 50_000)], key=str)
    assert kept["near dedup"] == sorted((r for r in rows if r[0] != 2), key=str)
    assert kept["benchmark decontamination"] == sorted(rows, key=str)
    pieces = corpus_pipeline.packing_stage(spark, docs, str(tmp_path))
    # Null, empty and blank texts have no tokens but the end.
    assert pieces.filter("start = 0 AND length = 1").count() == 4 and corpus_pipeline.packing_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
