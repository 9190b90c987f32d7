import collections
import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tamarack.llm import lm_scoring, mixing, url_filter
from tamarack.llm import sentencepiece_ops as sp
from tests.llm.helpers import awkward, key, prose, table


@pytest.fixture(scope="module")
def vocab():
    return sp.Vocabulary.load()


def all_paths(word, vocab):
    """Every segmentation of a marked word with its probability, by plain recursion."""
    log = {vocab.pieces[i]: float(p) for i, p in zip(vocab.ids.tolist(), vocab.log_p)}

    def go(at):
        if at == len(word):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in log:
                out += [((word[at:end], *rest), log[word[at:end]] + w) for rest, w in go(end)]
        return out

    found = go(0)
    z = math.log(sum(math.exp(w) for _, w in found))
    return {p: math.exp(w - z) for p, w in found}


def test_sampling_follows_the_lattice(vocab):
    """First samples come with their probability, the second as without replacement, and p / inclusion sums to 1."""
    paths, n = all_paths("▁theo", vocab), 8000
    s = sp.Sampler(vocab, 3)
    got = s.run(np.arange(n, dtype=np.uint64), ["theo"] * n)
    firsts, seconds, totals = collections.Counter(), collections.Counter(), []
    for samples in got:
        names = [tuple(vocab.pieces[i] for i in s.token_ids(p)) for p in samples]
        assert len(set(names)) == len(names) and [p["perturbed"] for p in samples] == sorted((p["perturbed"] for p in samples), reverse=True)
        assert all(math.exp(p["log_p"]) == pytest.approx(paths[x], rel=1e-3) for p, x in zip(samples, names))
        firsts[names[0]] += 1
        seconds[names[1]] += 1
        totals.append(sum(math.exp(p["log_p"]) / p["inclusion"] for p in samples))
    for p, q in paths.items():
        assert firsts[p] / n == pytest.approx(q, abs=4 * math.sqrt(q / n) + 1e-3)
        second = sum(paths[a] * q / (1 - paths[a]) for a in paths if a != p)
        assert seconds[p] / n == pytest.approx(second, abs=4 * math.sqrt(second / n) + 1e-3)
    assert np.mean(totals) == pytest.approx(1, abs=0.02)


def test_deep_regions_are_opened_exactly(vocab):
    """With one region held by itself all later ones are opened together: the law must not change."""
    n, text = 6000, "to be or"
    counts = []
    for near in (1, 24):
        s = sp.Sampler(vocab, 2, near=near)
        got = s.run(np.arange(n, dtype=np.uint64) + np.uint64(near * 10**6), [text] * n)
        counts.append(collections.Counter(tuple(s.token_ids(p[1]).tolist()) for p in got))
    for path in set(counts[0]) | set(counts[1]):
        a, b = counts[0][path] / n, counts[1][path] / n
        assert a == pytest.approx(b, abs=5 * math.sqrt(max(a, b) / n) + 1e-3)


def test_few_segmentations_are_all_emitted(vocab):
    s = sp.Sampler(vocab, 5)
    samples = s.run(np.array([3], np.uint64), ["a"])[0]
    assert len(samples) == len(all_paths("▁a", vocab)) and all(p["inclusion"] == 1.0 for p in samples)
    assert s.run(np.array([3], np.uint64), [""])[0][0]["log_p"] == 0.0


@pytest.mark.parametrize("alpha", [0.1, 0.25, 1.0, 2.0])
def test_every_segmentation_comes_at_any_alpha(alpha):
    """With k over their number, all segmentations come, however unlikely, each once and with its probability."""
    v = sp.Vocabulary.load(alpha=alpha)
    for word, k in (("a", 10), ("theo", 20), ("information", 1100)):
        paths = all_paths("▁" + word, v)
        s = sp.Sampler(v, k)
        got = {tuple(v.pieces[i] for i in s.token_ids(p)): p["log_p"] for p in s.run(np.array([5], np.uint64), [word])[0]}
        assert got.keys() == paths.keys()
        assert all(got[p] == pytest.approx(math.log(q), rel=1e-3, abs=1e-3) for p, q in paths.items())


def test_units_keep_the_law(vocab):
    """Cut into units, a text has the segmentations of its whole lattice, with the same probabilities."""
    text, n = "a,b an.", 4000
    paths = all_paths("▁" + text.replace(" ", "▁"), vocab)
    units, which, count = vocab.units([text, "", text])
    assert count.tolist()[1] == 0 and "".join(units[i] for i in which[: count[0]]) == "▁" + text.replace(" ", "▁") and count[0] > 2
    s = sp.Sampler(vocab, 1)
    firsts = collections.Counter(tuple(vocab.pieces[i] for i in s.token_ids(x[0])) for x in s.run(np.arange(n, dtype=np.uint64), [text] * n))
    for p, q in paths.items():
        assert firsts[p] / n == pytest.approx(q, abs=4 * math.sqrt(q / n) + 1e-3)


def test_units_of_one_hash_are_told_apart(vocab):
    """If hashes of different units were equal (here: all of them), units are compared as text."""
    import copy

    v = copy.copy(vocab)
    v.power = np.zeros(1 << 12, np.uint64)
    units, which, _ = v.units(["ab, ab. x", "x ab"])
    plain, order, _ = vocab.units(["ab, ab. x", "x ab"])
    assert [units[i] for i in which] == [plain[i] for i in order]


def test_the_query_equals_brute_force(spark, tmp_path, vocab):
    """Through Spark: of every short text two different segmentations with their probabilities; null, empty and very long texts."""
    from tamarack.llm import queries

    texts = {i: t for i, t in enumerate(["theo", "a", "to be", "", None, "x▁y", "a" * 30_000, "zq" * 20 + " " + "漢" * 5])}
    table(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.defaultdict(list)
    for r in queries.op1_sentencepiece(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append(r)
    assert got.keys() == texts.keys()
    assert len(got[4]) == 1 and got[4][0]["n_pieces"] is None and got[4][0]["round_trip"] is None
    assert len(got[3]) == 1 and got[3][0]["n_pieces"] == 0 and got[3][0]["log_p"] == 0.0
    for i in (0, 1, 2):
        paths = all_paths("▁" + texts[i].replace(" ", "▁"), vocab)
        sampled = sp.sample_encode(table(spark, [(i, texts[i])]), vocab, k=2).first()
        assert len(got[i]) == min(2, len(paths)) and [r["n_pieces"] for r in got[i]] == [len(x) for x in sampled["ids"]]
        for r, ids in zip(got[i], sampled["ids"]):
            assert math.exp(r["log_p"]) == pytest.approx(paths[tuple(vocab.pieces[x] for x in ids)], rel=1e-3)
    assert all(r["round_trip"] and len(got[i]) == 2 for i in (5, 6, 7) for r in got[i])


@pytest.mark.parametrize("extra", [False, True])
def test_sample_encode(spark, vocab, extra):
    out = sp.sample_encode(table(spark, extra=extra), vocab, k=2, run_chars=500).collect()
    assert len(out) == len(awkward())
    for r in out:
        if r["doc_id"] == 3:
            assert all(r[c] is None for c in ("ids", *sp.NUMBERS, "round_trip"))
            continue
        assert r["round_trip"] and len(r["ids"]) == len(r["inclusion"]) and all(0 <= x <= 1 for x in r["inclusion"]) and all(-1e9 < x <= 0 for x in r["log_inclusion"])
    twins = [r["ids"] for r in out if r["doc_id"] == 2]
    assert twins[0] == twins[1]
    assert sp.sample_encode(table(spark, []), vocab).count() == 0


def test_samples_do_not_depend_on_partitioning(spark, vocab):
    df = table(spark, [(i, prose(i, 50)) for i in range(30)])
    a = {r["doc_id"]: (r["ids"], r["log_p"]) for r in sp.sample_encode(df.repartition(5), vocab, run_chars=300).collect()}
    b = {r["doc_id"]: (r["ids"], r["log_p"]) for r in sp.sample_encode(df.repartition(1), vocab).collect()}
    assert {k: v[0] for k, v in a.items()} == {k: v[0] for k, v in b.items()}


def test_encode_and_decode(spark, vocab):
    df = table(spark, [r for r in awkward() if r[0] != 9])  # the library itself turns a literal mark into a space
    back = sp.decode(sp.encode(df), vocab).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=lambda r: (key(r[0]), str(r[1]))) == sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (key(r[0]), str(r[1])))


def brute_scores(docs, target, background=None, leave_out=True, weight=0.7, smoothing=1e-3):
    """(doc_id, n_tokens, ce_target, ce_background) by plain counters, for rows (doc_id, text)."""
    words = lambda t: (t or "").lower().split()
    corpora = {"t": [words(t) for d, t in docs if d in target], "b": [words(t) for _, t in (docs if background is None else background)]}
    vocabulary = {w for c in corpora.values() for ws in c for w in ws}
    count = lambda corpus: (collections.Counter(p for ws in corpus for p in zip([None, *ws], ws)), collections.Counter(p for ws in corpus for p in [None, *ws][: len(ws)]), collections.Counter(w for ws in corpus for w in ws))
    models = {m: (*count(c), sum(map(len, c))) for m, c in corpora.items()}
    out = []
    for d, t in docs:
        ws, means = words(t), []
        for m in ("t", "b"):
            pairs, contexts, single, size = models[m]
            mine = leave_out and (d in target if m == "t" else background is None)
            p0, c0, w0 = count([ws]) if mine else ({}, {}, {})
            size -= len(ws) * mine
            extra, loss = smoothing * max(1, size), 0.0
            for h, w in zip([None, *ws], ws):
                uni = (single[w] - w0.get(w, 0) + extra / max(1, len(vocabulary))) / (size + extra)
                c = contexts[h] - c0.get(h, 0)
                loss -= math.log(weight * (pairs[h, w] - p0.get((h, w), 0)) / c + (1 - weight) * uni if c else uni)
            means.append(loss / len(ws) if ws else None)
        out.append((d, len(ws), *means))
    return sorted(out, key=lambda r: (key(r[0]), r[1]))


def same_scores(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (key(r[0]), r[1]))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for g, w in zip(got, want):
        if w[1] == 0:
            assert g[2:] == (None, None, None)
        else:
            assert g[2:] == pytest.approx((w[2], w[3], w[2] - w[3]), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("leave_out", [True, False])
@pytest.mark.parametrize("extra", [False, True])
def test_lm_scores_equal_brute_force(spark, leave_out, extra):
    """Every word and bigram counts, whatever the blocks, the parts and the way the marks return."""
    rows = awkward() + [(i, prose(i, 40)) for i in range(30, 60)] + [(92, "never seen words"), (93, "x" * 100_000), (94, "a a a a b")]
    target = {1, 2, 5, 10, None, 92, *range(30, 38)}
    ids = spark.createDataFrame([(i,) for i in target] + [(1,)], "id long")
    want = brute_scores(rows, target - {None}, leave_out=leave_out)
    for sizes in ({}, {"block_tokens": 300, "part_entries": 50, "max_marks": 0}):
        same_scores(lm_scoring.score(table(spark, rows, extra).repartition(3), ids, leave_out=leave_out, **sizes).collect(), want)


def test_lm_scores_against_another_background(spark):
    docs, corpus = awkward(), [(i, prose(i, 50)) for i in range(9)] + [(None, None)]
    ids = spark.createDataFrame([(1,), (6,)], "id long")
    want = brute_scores(docs, {1, 6}, corpus)
    for size in (3_000_000, 100):
        same_scores(lm_scoring.score(table(spark, docs, extra=True), ids, table(spark, corpus), block_tokens=size).collect(), want)


def test_lm_edge_tables(spark):
    none, no_ids = table(spark, []), spark.createDataFrame([], "id long")
    assert lm_scoring.score(none, no_ids).count() == 0
    same_scores(lm_scoring.score(table(spark), no_ids).collect(), brute_scores(awkward(), set()))
    same_scores(lm_scoring.score(table(spark), no_ids, none).collect(), brute_scores(awkward(), set(), []))


def test_lm_query_equals_brute_force(spark, sf_dir):
    from tamarack.llm import queries

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["quality"] == 1 and r["toxic"] == 0}
    same_scores(queries.op6_lm_scoring(spark, sf_dir).collect(), brute_scores(docs, good))


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, k, 60) for k in (5, 3, 4)]
    tokens = rng.integers(1, 1000, 60).astype(float)
    aims = [rng.dirichlet(np.ones(k)) for k in (5, 3, 4)]
    factor, error = mixing.rake(keys, tokens, aims)
    share = factor * tokens / (factor * tokens).sum()
    assert error < 1e-6 and all(np.allclose(np.bincount(k, share, len(a)), a, atol=1e-6) for k, a in zip(keys, aims))


def test_calibration_spends_the_budget():
    factor, tokens = np.array([4.0, 1.0, 0.5, 0.0]), np.array([10.0, 50.0, 100.0, 30.0])
    p = mixing.calibrate(factor, tokens, 60)
    assert (p * tokens).sum() == pytest.approx(60) and p.max() <= 1 and p[3] == 0 and p[0] >= p[1] >= p[2]
    assert mixing.calibrate(factor, tokens, 500).tolist() == [1, 1, 1, 0]


def brute_mix(cells, targets, budget, power=0.7):
    """{cell: (weight, prob)} by plain loops: scale every marginal in turn, then bisect for the scale of the chances."""
    total = sum(cells.values())
    w = {c: t / total for c, t in cells.items()}
    for _ in range(200):
        worst = 0.0
        for axis, name in enumerate(("source", "lang", "topic")):
            now, mass = collections.Counter(), collections.Counter()
            for c in cells:
                now[c[axis]] += w[c]
                mass[c[axis]] += cells[c]
            goal = {v: (targets or {})[name].get(v, 0.0) if (targets or {}).get(name) else mass[v] ** power for v in now}
            whole = sum(g for v, g in goal.items() if now[v] > 0)
            for v in goal:
                worst = max(worst, abs(now[v] - goal[v] / whole)) if now[v] > 0 else worst
            w = {c: x * goal[c[axis]] / whole / now[c[axis]] if now[c[axis]] > 0 else 0.0 for c, x in w.items()}
        if worst < 1e-9:
            break
    f = {c: w[c] / (cells[c] / total) if cells[c] else 0.0 for c in cells}
    low, high = 0.0, 1e9
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(min(1, s * f[c]) * cells[c] for c in cells) < budget * total else (low, s)
    return {c: (f[c], min(1, high * f[c])) for c in cells}


def with_empty_cells(chances, cells, budget):
    """Chances with those of cells without a token: the share kept in their source and language, else of all."""
    out = dict(chances)
    for c in cells:
        if not cells[c]:
            near = [x for x in cells if x[:2] == c[:2] and cells[x]] or [x for x in cells if cells[x]]
            total = sum(cells[x] for x in near)
            out[c] = (chances[c][0], sum(chances[x][1] * cells[x] for x in near) / total if total else budget)
    return out


def test_raking_at_every_size_equals_brute_force(spark):
    """One algorithm: in numpy and as tables the same weights, chances and error."""
    cells = {(f"s{i % 4}", f"l{i % 3}", f"t{i % 5}"): 10 + 7 * i for i in range(60) if i % 7}
    df = spark.createDataFrame([(*c, t) for c, t in cells.items()], "_source string, _lang string, _topic string, _tokens long")
    for targets, budget in (({"lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}, 0.8), (None, 0.35)):
        want = brute_mix(cells, targets, budget)
        for most in (100, 2):
            got = {tuple(r)[:3]: r for r in mixing.cell_probabilities(df, targets, budget, max_driver_cells=most).collect()}
            assert got.keys() == want.keys() and all(r["marginal_error"] < 1e-9 for r in got.values())
            assert all((got[c]["weight"], got[c]["prob"]) == pytest.approx(want[c], rel=1e-6) for c in want)


def test_contradicting_targets_are_reported(spark):
    """Where no table has the marginals, both ways stop after the same rounds with the same error."""
    df = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 30)], "_source string, _lang string, _topic string, _tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.2, "y": 0.8}}
    got = [mixing.cell_probabilities(df, targets, max_driver_cells=n, rounds=4).orderBy("_source").collect() for n in (9, 1)]
    assert all(r["marginal_error"] == pytest.approx(0.7, abs=0.01) for rows in got for r in rows)
    assert [tuple(r)[3:] for r in got[0]] == [pytest.approx(tuple(r)[3:], rel=1e-9) for r in got[1]]


def test_mix(spark):
    out = mixing.mix(table(spark, extra=True)).collect()
    assert len(out) == len(awkward()) and all(0 <= r["prob"] <= 1 for r in out)
    assert {r["kept"] for r in out if r["doc_id"] == 2} in ({True}, {False})
    assert {r["topic"] for r in out if r["doc_id"] in (3, 4, 7)} == {"(none)"}
    tokens = {(r["doc_id"], r["n_tokens"]) for r in out}
    assert tokens == {(i, len("".join(c if c > " " else " " for c in t or "").split(" ")) - "".join(c if c > " " else " " for c in t or "").split(" ").count("")) for i, t in awkward()}
    many = table(spark, [(i, prose(i, 20 + i % 50)) for i in range(3000)])
    got = mixing.mix(many, {"source": {"s1": 1.0}}, budget=0.5)
    t = got.agg(F.sum(F.when(F.col("kept"), F.col("n_tokens"))).alias("k"), F.sum("n_tokens").alias("n")).first()
    assert t["k"] / t["n"] == pytest.approx(0.5, abs=0.05)
    odd = many.withColumn("_topic", F.lit("mine")).withColumn("prob", F.col("doc_id") + 1).withColumn("c1", F.lit("c"))
    kept = mixing.mixed_rows(odd, {"source": {"s1": 1.0}}, budget=0.5)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got.filter("kept").collect()}
    assert all(r["_topic"] == "mine" and r["prob"] == r["doc_id"] + 1 for r in kept.take(50))
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed_rows(table(spark, [])).count() == 0
    assert {r["topic"] for r in mixing.mix(odd, topic_column="_topic").take(20)} == {"mine"}


def test_mix_query_equals_brute_force(spark, sf_dir):
    """The chances of the query from plain loops over its own cells; the draws follow them."""
    from tamarack.llm import queries

    rows = queries.op9_mixing(spark, sf_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    cells = collections.Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert (r["source"], r["lang"]) == (d["source"] or "(none)", d["lang"] or "(none)")
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    want = with_empty_cells(brute_mix(cells, None, 0.8), cells, 0.8)
    assert all((r["weight"], r["prob"]) == pytest.approx(want[r["source"], r["lang"], r["topic"]], rel=1e-5) for r in rows)
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and len({r["topic"] for r in rows}) > 2
    hope = sum(r["prob"] * r["n_tokens"] for r in rows)
    spread = math.sqrt(sum(r["prob"] * (1 - r["prob"]) * r["n_tokens"] ** 2 for r in rows))
    assert abs(sum(r["n_tokens"] for r in rows if r["kept"]) - hope) < 5 * spread + 1


def test_topics_are_learnt(spark):
    """Texts of three word lists come apart; classes don't depend on partitioning; a text is classed by all its words."""
    from tamarack.llm import topics

    lists = ["sea ship sail wind harbour wave anchor crew".split(), "bread oven flour yeast salt dough crust bake".split(), "code bug test build merge branch commit deploy".split()]
    rows = [(i, " ".join(lists[i % 3][(i * 7 + j * 3) % 8] for j in range(30))) for i in range(300)]
    model = topics.fit(table(spark, rows).repartition(5), topics=3)
    again = topics.fit(table(spark, rows).repartition(2), topics=3)
    assert np.array_equal(model.weights, again.weights)
    got = {r["_id"]: r["_topic"] for r in topics.topics_and_tokens(table(spark, rows), [F.col("doc_id").alias("_id")], model).collect()}
    assert len({got[i] for i in range(3)}) == 3 and all(got[i] == got[i % 3] for i in got)


def test_topic_passes_read_runs_of_documents(spark, monkeypatch):
    """A pass reads a row for many documents; runs hold every document once, one longer than a run too."""
    from tamarack.llm import topics

    rows = [(i, f"one{i % 9} two{i % 5} three") for i in range(500)] + [(900, " ".join(f"w{i}" for i in range(3000))), (901, None), (902, " ")]
    monkeypatch.setattr(topics, "CELLS", 400)
    held = topics.bags(table(spark, rows).coalesce(1), topics.FEATURES)
    assert 4 <= held.count() <= 8
    size = 1 << topics.FEATURES.bits
    unit = topics.scaled(held, np.ones(size)).toArrow()
    found = list(topics.units(unit.to_batches()))
    assert sum(len(k) for k, *_ in found) == 501 and max(len(r) for _, _, r, _ in found) > 2000
    centres = np.random.default_rng(1).random((3, size)).astype(np.float32)
    for _, cuts, at, x in found:
        want = [[(x[i:j] / topics.SCALE) @ c[at[i:j]] for i, j in zip(cuts, cuts[1:])] for c in centres]
        assert topics.products(cuts, at, x, centres) == pytest.approx(np.array(want), rel=1e-4)


def test_topic_rounds_read_only_documents_that_may_change(spark, monkeypatch):
    import numpy as np

    from tamarack.llm import topics

    rows = [(i, prose(i, 12) + f" own{i % 3}" * (i % 4)) for i in range(400)]
    summed, read = topics.summed, []

    def counted(held, centres, size):
        total, n = summed(held, centres, size)
        read.append(int(n.sum()))
        return total, n

    monkeypatch.setattr(topics, "summed", counted)
    narrow = topics.fit(table(spark, rows), topics=4)
    few, read[:] = list(read), []
    monkeypatch.setattr(topics, "CALM", -1.0)
    whole = topics.fit(table(spark, rows), topics=4)
    assert narrow.classes == whole.classes and np.array_equal(narrow.weights, whole.weights)
    assert set(read) == {400} and len(read) > 6 and min(few) < 200


def test_mixing_sends_small_batches(spark, monkeypatch):
    from tamarack.llm import common, mixing, topics

    name, sizes = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    for module, step in ((topics, "summed"), (mixing, "features")):
        monkeypatch.setattr(module, step, lambda *a, f=getattr(module, step), **b: sizes.append(spark.conf.get(name)) or f(*a, **b))
    rows = [(i, prose(i, 30)) for i in range(20)]
    assert mixing.mix(table(spark, rows)).count() == 20 and mixing.mixed_rows(table(spark, rows)).count() > 0
    assert set(sizes) == {str(common.BATCH_BYTES)} and spark.conf.get(name) == before


def test_topics_are_learnt_from_every_document(spark):
    """A subject that four documents in six thousand have is counted: the words' weights come from all rows, repeated ones too."""
    from tamarack.llm import topics

    rows = [(i, f"common{i % 7} other{i % 5}") for i in range(6000)] + [(10000 + i, f"rare seldom word{i}") for i in range(4)]
    held = topics.bags(table(spark, rows + rows[-1:]), topics.FEATURES)
    frequency, n = topics.summed(held, None, 1 << topics.FEATURES.bits)
    assert n.tolist() == [6005] and frequency.sum() == 2 * 6000 + 3 * 5
    many = topics.fit(table(spark, rows).repartition(7), topics=3)
    few = topics.fit(table(spark, rows).coalesce(1), topics=3)
    assert np.array_equal(many.weights, few.weights)
    weights = topics.summed(topics.scaled(held, np.ones(1 << topics.FEATURES.bits)), many.weights * 0, 1 << topics.FEATURES.bits)
    assert weights[1].sum() == 6005


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([("bad.com", "malware", "add", day(10)), ("bad.com", "malware", "remove", day(20)), ("bad.com", "malware", "add", day(30)), ("x.bad.com", "spam", "add", day(15)), ("BAD.com", "malware", "add", day(10)), (None, "a", "add", day(1)), ("z.com", None, "odd", day(1))], "key string, category string, action string, at date")
    rows = [(1, "http://x.BAD.com/p", day(9)), (2, "http://y.bad.com", day(10)), (3, "http://y.bad.com", day(20)), (4, "https://u@x.bad.com:80/", day(16)), (5, "http://bad.com?q", day(99)), (6, "nonsense", day(12)), (7, None, day(12)), (8, "http://bad.com", None), (2, "http://y.bad.com", day(10)), (9, "http://notbad.com", day(12))]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched_at date").withColumn("category", F.lit("clash"))
    got = sorted((r["page_id"], r["blocked"], r["matched_key"], r["category"], r["n_active"]) for r in url_filter.judge(caps, entries).collect())
    want = [(1, False, None, None, 0), (2, True, "bad.com", "malware", 1), (2, True, "bad.com", "malware", 1), (3, False, None, None, 0), (4, True, "x.bad.com", "spam", 2), (5, True, "bad.com", "malware", 1), (6, False, None, None, 0), (7, False, None, None, 0), (8, False, None, None, 0), (9, False, None, None, 0)]
    assert got == want
    assert url_filter.judge(caps.limit(0), entries).count() == 0 and url_filter.judge(caps, entries.limit(0)).filter("blocked").count() == 0


def test_pipeline_equals_brute_force(spark, sf_dir, vocab):
    """Every stage on all that its predecessor kept, held against plain Python; the columns of documents until the last."""
    from tamarack.llm import quality_classifier
    from tests.llm.test_dedup import brute_components, brute_runs

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing", "sentencepiece"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    held = rows(docs)

    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    raw = [(r[1] or "").encode() for r in held]
    p = model.probabilities(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[:, 1]
    good = [r for r, x in zip(held, p) if x >= 0.3]
    out = stages["quality classifier"](spark, docs, sf_dir)
    assert out.columns == names and rows(out) == good and 0 < len(good) < len(held)

    at = lambda kept: spark.createDataFrame(kept, docs.schema)
    clean = []
    for r, (_, t, n) in zip(good, brute_runs([(r[0], r[1]) for r in good])):
        if not n or (t and t.strip()):
            clean.append((r[0], t, *r[2:4], len(t) if n else r[4]))
    out = stages["line dedup"](spark, at(good), sf_dir)
    assert out.columns == names and rows(out) == sorted(clean) and any(a != b for a, b in zip(good, clean))

    least = {d for d, c in brute_components([(r[0], r[1]) for r in clean]) if d == c}
    single = [r for r in clean if r[0] in least]
    out = stages["simhash near-dedup"](spark, at(clean), sf_dir)
    assert out.columns == names and rows(out) == sorted(single)

    verdicts = {r["doc_id"]: r for r in mixing.mix(at(single)).collect()}
    cells = collections.Counter()
    for r in verdicts.values():
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    chances = with_empty_cells(brute_mix(cells, None, 0.8), cells, 0.8)
    draws = {r["doc_id"]: r["u"] for r in at(single).select("doc_id", (F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u")).collect()}
    mixed = [r for r in single if draws[r[0]] < chances[tuple(verdicts[r[0]][c] for c in ("source", "lang", "topic"))][1]]
    out = stages["mixing"](spark, at(single), sf_dir)
    assert out.columns == names and rows(out) == sorted(mixed) and 0 < len(mixed) < len(single)

    out = {r["doc_id"]: r for r in stages["sentencepiece"](spark, at(mixed), sf_dir).collect()}
    turn = sp.decoder(vocab.pieces, vocab.byte_ids)
    assert out.keys() == {r[0] for r in mixed}
    for r in mixed:
        got = out[r[0]]
        assert got["round_trip"] and len(got["ids"]) <= 2 and len({tuple(x) for x in got["ids"]}) == len(got["ids"])
        assert all(turn(np.array(x)) == r[1] for x in got["ids"]) and got["n_pieces"] == [len(x) for x in got["ids"]]
    whole = {r["doc_id"]: (r["ids"], r["round_trip"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == {d: (r["ids"], r["round_trip"]) for d, r in out.items()}


def test_documents_without_a_token_are_kept_like_others(spark):
    """They take their source's and language's share, else that of all; a budget of all keeps every row."""
    rows = [(i, None if i % 4 == 0 else "" if i % 4 == 1 else " \n" if i % 4 == 2 else prose(i, 30), "en" if i % 3 else None, "s1" if i < 300 else "only empty", None) for i in range(400)]
    rows = [r for r in rows if r[3] == "s1" or r[0] % 4 < 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert mixing.mix(df, budget=1.0).filter("kept").count() == len(rows) == mixing.mixed_rows(df, budget=1.0).count()
    got = mixing.mix(df, budget=0.5).collect()
    cells = collections.Counter()
    for r in got:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    want = with_empty_cells(brute_mix(cells, None, 0.5), cells, 0.5)
    assert all(r["prob"] == pytest.approx(want[r["source"], r["lang"], r["topic"]][1], rel=1e-5) for r in got)
    assert all(r["prob"] > 0 for r in got if not r["n_tokens"])
    blank = df.filter("doc_id % 4 = 0")
    assert {r["prob"] for r in mixing.mix(blank, budget=0.25).collect()} == {0.25}


def test_hosts(spark):
    """Dots at the end, addresses, brackets, blanks and credentials."""
    urls = {"http://Evil.COM./x": "evil.com", " \thttps://evil.com": "evil.com", "http://1.2.3.4/": "1.2.3.4", "http://[2001:DB8::1]:80/": "[2001:db8::1]", "http://u:p@evil.com:8080?q": "evil.com", "http://a.b.evil.com": "a.b.evil.com", "http://": None, "evil.com": None, "http://...": None, "http://" + "x" * 9000 + ".com/" + "y" * 90000: "x" * 9000 + ".com"}
    df = spark.createDataFrame([(i, u, day(5)) for i, u in enumerate(urls)], "page_id long, url string, fetched_at date")
    entries = spark.createDataFrame([(k, "c", "add", day(1)) for k in ("Evil.com.", "3.4", "2.3.4", "[2001:db8::1]", ".", " ", "x" * 9000 + ".com")], "key string, category string, action string, at date")
    got = {r["page_id"]: r for r in url_filter.judge(df, entries).collect()}
    assert [got[i]["host"] for i in range(len(urls))] == list(urls.values())
    assert [got[i]["blocked"] for i in range(len(urls))] == [True, True, False, True, True, True, False, False, False, True]
    four = spark.createDataFrame([("1.2.3.4", "c", "add", day(1))], "key string, category string, action string, at date")
    assert [r["page_id"] for r in url_filter.judge(df, four).filter("blocked").collect()] == [2]


def test_pipeline_of_awkward_rows(spark, tmp_path):
    """Which of null, empty and repeated rows pass each stage; clashing columns; an empty table gives an empty result."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stages = dict(corpus_pipeline.STAGES)
    for name, data in (("odd", None), ("none", [])):
        docs = table(spark, data)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = f"{tmp_path}/{name}"
        out = corpus_pipeline.run(spark, at).collect()
        assert all(r["round_trip"] in (True, None) for r in out) and (data is None or not out)
    at, every = f"{tmp_path}/odd", sorted(awkward(), key=str)
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("n_lines_removed", F.lit("clash"))
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    good = stages["quality classifier"](spark, docs, at)
    assert pairs(good) == every and good.columns == docs.columns  # nothing to learn from: all have the prior, a half
    lines = stages["line dedup"](spark, good, at)
    left = [(i, t) for i, t in every if i != 2]  # the copies of document 1 lose all their lines, and what had none stays
    assert lines.columns == docs.columns and {r["n_lines_removed"] for r in lines.collect()} == {"clash"}
    assert [i for i, _ in pairs(lines)] == [i for i, _ in sorted(left, key=str)] and {3, 4, 7} <= {i for i, _ in pairs(lines)}
    single = pairs(stages["simhash near-dedup"](spark, lines, at))
    assert {i for i, _ in single} & {3, 4, 7} == {3} and {None, 1, 5, 9, 10} <= {i for i, _ in single}
    mixed = stages["mixing"](spark, lines, at)
    kept = {r["doc_id"] for r in mixing.mix(lines, budget=0.8).filter("kept").collect()}
    assert {i for i, _ in pairs(mixed)} == kept and mixed.columns == docs.columns
    got = {r["doc_id"]: r for r in stages["sentencepiece"](spark, lines, at).collect()}
    assert got.keys() == {i for i, _ in left} and got[3]["ids"] is None and all(got[i]["round_trip"] for i in got if i != 3)


def test_the_count_of_removed_lines_has_a_free_name(spark):
    from tamarack.llm import line_dedup

    df = table(spark).withColumn("n_lines_removed", F.lit(1))
    with pytest.raises(ValueError, match="n_lines_removed"):
        line_dedup.line_dedup(df)
    out = line_dedup.line_dedup(df, count="gone")
    assert out.columns == [*df.columns, "gone"] and {r["n_lines_removed"] for r in out.collect()} == {1}


def test_kept_lattices_change_no_sample(spark):
    """However few lattices a worker keeps for later runs, samples are the same."""
    from tamarack.llm import sentencepiece_ops

    rows = [(i, f"some words {i * 37} and unusual{i}ness again") for i in range(60)]
    vocab = sentencepiece_ops.Vocabulary.load()
    many, few = (sorted(map(repr, sentencepiece_ops.sample_encode(table(spark, rows).coalesce(1), vocab, k=2, run_chars=200, most_nodes=n).collect())) for n in (1_000_000, 50))
    assert many == few
