"""Operators on single documents, packing, mixing, lines, the pipeline; and the queries beside their SQL."""

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cinderlog.llm import language, line_dedup, mixing, packing, quality
from cinderlog.llm.queries import ORACLES, QUERIES, vocabulary
from workload.compare import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_language(spark):
    rows = [(i, "the quick fox and the dog " * 3, "en", "s", 1) for i in range(9)] + [(20 + i, "der schnelle Fuchs über dem Hund " * 3, "de", None, 1) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs)
    odd = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "12 !?", 7), (4, "the dog and fox", 7), (4, "über dem Hund " * 200_000, 7)], "doc_id long, text string, score int")
    got = language.identify(odd, model).orderBy("doc_id", F.length("text")).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got) and got[0].score == 0 and got[3].score > 0.5
    none = language.learn(docs.limit(0))
    assert [r.lang_pred for r in language.identify(docs.limit(2), none).collect()] == ["und"] * 2


def test_language_is_naive_bayes():
    texts, model = ["ab ba", "ba"], language.Model(["x", "y"], np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 2)), np.log([0.3, 0.7]))
    grams = defaultdict(list)
    for bucket, row in language.n_grams(texts):
        for b, r in zip(bucket.tolist(), row.tolist()):
            grams[r].append(b)
    assert len(grams[0]) == 4 + 5 + 4 and len(grams[1]) == 2 + 2 + 1  # without the blank alone; with the blank after a word
    names, scores = model.predict(texts)
    for i in range(2):
        value = np.exp([model.priors[k] + sum(model.logs[k][b] for b in grams[i]) for k in (0, 1)])
        assert names[i] == "xy"[int(value.argmax())] and abs(scores[i] - value.max() / value.sum()) < 1e-6


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(4)
    lines, stay = np.array([1, 4, 3]), draw.normal(size=(2, 2))
    logit = draw.normal(size=8)
    p, pair = quality.marginals(logit, stay, lines)
    at = 0
    for n in lines.tolist():
        total, good, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for code in range(2**n):
            y = [code >> t & 1 for t in range(n)]
            weight = np.exp(sum(logit[at + t] * y[t] for t in range(n)) + sum(stay[y[t], y[t + 1]] for t in range(n - 1)))
            total += weight
            good += weight * np.array(y)
            for t in range(n - 1):
                both[t, y[t], y[t + 1]] += weight
        assert np.allclose(p[at : at + n], good / total) and np.allclose(pair[at : at + n], both / total)
        at += n


def test_quality(spark):
    good, bad = "A plain line of words, as it is.\nAnd another one here.", "BUY!! NOW!! NOW!!\nCLICK!! HERE!!"
    rows = [(i, good if i % 2 else bad, None, None, 0) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (2, None, 0), (3, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.learn(spark.createDataFrame(rows, DOCS), labels)
    odd = spark.createDataFrame([(1, good, 0), (2, bad, 0), (3, None, 0), (4, "", 0), (5, good * 20_000, 0)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in quality.score(odd, field).collect()}
    assert [got[i].predicted for i in (1, 2, 5)] == [1, 0, 1] and got[3].score == got[4].score and 0 <= got[3].score <= 1
    nothing = quality.learn(spark.createDataFrame(rows, DOCS), labels.limit(0))
    assert {r.score for r in quality.score(odd, nothing).collect()} == {0.5}


def test_packing(spark):
    from tokenizers import Tokenizer

    spec = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_str(spec)
    draw = random.Random(1)
    texts = [" ".join(draw.choices(["house", "Über", "it's", "x1", "<|endoftext|>", "naïve\x1cy", "İΣ"], k=draw.choice((0, 3, 200, 900, 2500)))) for _ in range(60)]
    texts += ["", None, "a" * 5000, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").withColumn("piece", F.lit("x"))
    got = packing.pack(packing.pieces(docs, spec), part=16).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    places, parts = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append(r.piece)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert {i: sorted(p) for i, p in parts.items()} == {i: sorted([*range(-(-len(v) // 2048))] * (2 if i == 3 else 1)) for i, v in ids.items()}
    assert len(places) <= -(-sum(r.length for r in got) // 2048) * 1.1 + 1
    assert packing.pack(packing.pieces(docs.limit(0), spec)).count() == 0


def test_bounds_and_best_fit():
    draw = np.random.default_rng(0)
    for sizes in (draw.integers(1, 100, 200), np.full(10, 51), np.array([100]), draw.integers(30, 70, 80), np.zeros(0, np.int64)):
        bins, offsets, used = packing.best_fit(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= used
        assert used == len(set(bins.tolist())) and np.bincount(bins, weights=sizes, minlength=1).max() <= 100
    assert packing.lower_bound(np.full(10, 51), 100) == 10


def test_mixing(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.choice((0, 1, 5, 40, 300))), None, draw.choice(("a", "b", "b", "b", "é", None)), 0) for i in range(900)]
    rows += [(900, None, None, "b", 0), (5, "w w", None, "zero", 0), (5, "w w", None, "zero", 0), (7, "", None, "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) != [] and len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, whole, capped = {s: 1 + i % 3 for i, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        level = (whole - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if weight[s] * level > 3 * sizes[s]} - capped
        if not more:
            break
        capped |= more
    for s in names:
        assert abs(target[s] - (3 * sizes[s] if s in capped else weight[s] * level)) < 1e-6
        assert abs(taken[s] - target[s]) <= 150
    again = mixing.mix(docs.repartition(2)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(docs.limit(0)).count() == 0


def plain_sample(sizes, draws, rest):
    """Pareto sampling of one source by hand: which documents are taken, and their probabilities."""
    low, high = 0.0, 2.0
    for _ in range(200):
        rate = (low + high) / 2
        low, high = (rate, high) if sum(min(1.0, rate * s) * s for s in sizes.values()) < rest else (low, rate)
    chance = {i: min(1.0, high * s) for i, s in sizes.items()}
    sure = {i for i, p in chance.items() if p > 1 - 1e-9}
    left = rest - sum(sizes[i] for i in sure)
    rank = {i: draws[i] / (1 - draws[i]) * (1 - p) / p for i, p in chance.items() if i not in sure}
    chosen, order = set(sure), sorted(rank, key=rank.get)
    while order and sizes[order[0]] <= left:
        left -= sizes[order[0]]
        chosen.add(order.pop(0))
    best = min(order, key=lambda i: (abs(left - sizes[i]), rank[i]), default=None)
    if best is not None and abs(left - sizes[best]) < left:
        chosen.add(best)
    return chosen, chance


def test_mixing_is_pareto_sampling(spark):
    """The chosen documents are those of the plain version, and are chosen as often as their probabilities say."""
    draw = random.Random(11)
    kinds = [draw.choice((3, 10, 40, 90)) + draw.randrange(3) for _ in range(30)] + [400]
    rows = [(1000 * s + i, " ".join(["w"] * n), None, f"s{s:03d}", 0) for s in range(120) for i, n in enumerate(kinds)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    number = (F.shiftrightunsigned(F.xxhash64(F.lit(4), F.lit("mix"), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    draws = {r.doc_id: r.u for r in docs.select("doc_id", number.alias("u")).collect()}
    got, often = defaultdict(set), Counter()
    for r in mixing.mix(docs, seed=4).collect():
        if r.taken > r.size * int(r.target / r.source_size + 1e-12):
            got[r.source].add(r.doc_id)
    whole = sum(kinds)
    for s in range(120):
        own = {1000 * s + i: n for i, n in enumerate(kinds)}
        weight = 1 + s % 3
        if weight == 2:
            assert not got[f"s{s:03d}"]  # exactly one copy of each
            continue
        want, chance = plain_sample(own, draws, whole / 2)
        assert got[f"s{s:03d}"] == want
        often.update(i % 1000 for i in want)
    assert often[30] == 80  # larger than its probability allows: taken for certain
    for size in set(kinds):
        same = [i for i, n in enumerate(kinds) if n == size and i < 30]
        if len(same) > 1:
            assert abs(sum(often[i] for i in same) / len(same) / 80 - chance[1000 * s + same[0]]) < 0.12


def plain_lines(rows):
    """Chunks by hand: what every text keeps."""
    import hashlib

    number = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    seen, out = set(), {}
    for key, text in rows:
        lines, chunk, kept = (text or "").split("\n"), [], []
        for i, line in enumerate(lines):
            chunk.append(line)
            if i + 1 == len(lines) or (number(line) + 31 * number(lines[i - 1] if i else "")) % line_dedup.DIVISOR == 0:
                body = "\n".join(chunk)
                if len(chunk) < 2 or body not in seen:
                    kept.append(body)
                if len(chunk) > 1:
                    seen.add(body)
                chunk = []
        out[key] = None if text is None else "\n".join(kept)
    return out


def test_line_dedup(spark):
    draw = random.Random(2)
    lines = [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(lines[(a := draw.randrange(50)) : a + draw.randrange(12)] + draw.choices(lines, k=3))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[5][1]), (104, "\n".join(draw.choices(lines, k=20_000)))]
    frame = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, n_lines int, row int").coalesce(2)
    got = line_dedup.remove_repeated(frame).collect()
    assert {r.doc_id: r.text for r in got} == plain_lines(rows)
    assert {r.doc_id: r.n_lines for r in got} == {i: 0 if t is None else t.count("\n") + 1 for i, t in rows}
    assert all(r.row == 9 for r in got)
    twice = line_dedup.remove_repeated(spark.createDataFrame([(1, rows[0][1])] * 2, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r.kept_lines for r in twice)[0] < twice[0].n_lines
    assert line_dedup.remove_repeated(frame.limit(0)).count() == 0


@tables
def test_pipeline_stage_by_stage(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = [r.asDict() for r in docs.collect()]
        assert name == "best_fit_packing" or docs.columns == columns
    chosen = {r["doc_id"] for r in kept["quality_classifier"]}
    good, bad = [r.doc_id for r in labels if r.quality], [r.doc_id for r in labels if not r.quality]
    assert np.mean([i in chosen for i in good]) > 0.97 and np.mean([i in chosen for i in bad]) < 0.2
    order = sorted((r["doc_id"], r["text"]) for r in kept["quality_classifier"])
    assert {r["doc_id"]: r["text"] for r in kept["line_dedup"]} == {i: t for i, t in plain_lines(order).items() if t or not dict(order)[i]}
    from tests.llm.test_pairs import grouped, sets

    rows = [(r["doc_id"], r["text"]) for r in kept["line_dedup"]]
    own = sets([t for _, t in rows], 5)
    pairs = [(i, j) for i in range(len(own)) for j in range(i) if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])]
    assert sorted(r["doc_id"] for r in kept["ngram_jaccard_join"]) == sorted(set(grouped(len(rows), pairs, [i for i, _ in rows])))
    assert {r["doc_id"] for r in kept["source_mixing"]} == {r["doc_id"] for r in kept["best_fit_packing"]}
    pieces = Counter((r["doc_id"], r["piece"]) for r in kept["best_fit_packing"])
    times = Counter(r["doc_id"] for r in kept["source_mixing"])
    assert all(pieces[i, 0] == n for i, n in times.items())


def test_stages_leave_odd_rows_and_columns_alone(spark):
    """Columns that are named like an operator's own, nulls, repeated rows, and an empty table."""
    clean = "A plain line of words, as it is written.\nAnd another one that follows it here."
    texts = [clean, clean, None, "", "other words that stand alone in a text of their own, ten or more", "only one line of it"]
    names = ("row", "_row", "_size", "_copy", "score", "predicted", "n_lines", "kept_lines", "t1", "_text", "node", "_others")
    rows = [(i if i else None, t, "en", "s" if i % 2 else None, 5, *[i * 10 + n for n in range(len(names))]) for i, t in enumerate(texts)]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {n} int" for n in names))
    extra = {r[1]: set() for r in rows}
    for r in rows:
        extra[r[1]].add(r[5:])
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[5:] in extra[r.text] for r in got if r.text in extra), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        if name == "ngram_jaccard_join":
            assert sorted(str(r.doc_id) for r in got) == ["2", "3", "4", "5", "None"]


def test_rows_keep_their_numbers_over_scans(spark):
    """Another parallelism between the jobs of one run numbers the rows of a scan anew; results must not notice."""
    import tempfile

    draw = random.Random(8)
    lines = [f"line number {i} of many" for i in range(40)]
    rows = [(i, "\n".join(lines[(a := draw.randrange(30)) : a + 9] + [f"own {i}"])) for i in range(300)]
    path = tempfile.mkdtemp() + "/docs"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(12).write.parquet(path)
    docs = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {r.doc_id: r.text for r in line_dedup.remove_repeated(docs).collect()}
    assert want == plain_lines(rows)
    from cinderlog.llm import ngram_join

    near = {r.doc_id: r.component_id for r in ngram_join.link(docs).collect()}
    try:
        cut, joined = line_dedup.remove_repeated(docs), ngram_join.link(docs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert {r.doc_id: r.text for r in cut.collect()} == want
        assert {r.doc_id: r.component_id for r in joined.collect()} == near
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@tables
@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, name):
    count, verdict = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict in ("ok", "rows-only") and count > 0
