import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tamarack.llm import line_dedup, simhash
from tamarack.llm.components import components
from tamarack.llm.exact_dedup import CountingQuotientFilter, exact_dedup, repeated_fingerprints
from tests.llm.helpers import key, prose, table


def test_filters_merge_losslessly():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(3)]
    merged = CountingQuotientFilter.of(parts[0])
    for p in parts[1:]:
        merged = merged.merge(CountingQuotientFilter.of(p))
    want = dict(zip(*(x.tolist() for x in np.unique(np.concatenate(parts), return_counts=True))))
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist())) == want
    assert all(merged.count(k) == n for k, n in want.items()) and merged.count(12345) == 0
    back = [CountingQuotientFilter.from_part(data) for _, data in merged.parts(4)]
    assert sorted(k for b in back for k in b.fingerprints().tolist()) == sorted(want)


def test_filters_hold_remainders_and_not_keys():
    """Sent bytes: a bit a quotient, two bits and a remainder a slot, and a byte or so for each count above one."""
    keys = np.random.default_rng(7).integers(0, 1 << 64, 5000, dtype=np.uint64)
    f = CountingQuotientFilter.of(np.r_[keys, keys[:100], np.repeat(keys[:1], 1000)])
    parts = list(f.parts(4))
    assert sum(len(d) for _, d in parts) <= 16 * (32 + 3) + (1 << 16) // 8 + 5000 * (6 + 0.25) + 100 * 2 < 8 * 5000 + (1 << 16) // 8
    for _, data in parts:
        assert not any(int(k).to_bytes(8, order) in data for k in keys for order in ("little", "big"))
    assert CountingQuotientFilter.of(keys, 24).remainders.shape == (5000, 5)
    with pytest.raises(ValueError):
        CountingQuotientFilter.of(keys, 10)


def test_variable_length_counts():
    from tamarack.llm.exact_dedup import of_varints, varints

    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, 5], np.int64)
    assert of_varints(varints(values)).tolist() == values.tolist() and len(varints(values)) == 3 + 2 * 3 + 3 + 6 + 1
    assert varints(values[:0]) == b"" and of_varints(b"").tolist() == []


def test_an_empty_filter():
    e = CountingQuotientFilter.of(np.zeros(0, np.uint64))
    assert len(e.fingerprints()) == 0 and e.merge(e).count(1) == 0 and list(e.parts(3)) == []


def test_repeated_fingerprints(spark):
    df = spark.createDataFrame([(i % 40,) for i in range(100)] + [(-5,)] * 3, "fp long").repartition(5)
    got = {r["fp"]: r["n"] for r in repeated_fingerprints(df, block_rows=8).collect()}
    assert got == {i: 3 if i < 20 else 2 for i in range(40)} | {-5: 3}


@pytest.mark.parametrize("extra", [False, True])
def test_exact_dedup(spark, extra):
    rows = [(r["doc_id"], r["text"]) for r in table(spark).collect()]
    got = sorted((tuple(r) for r in exact_dedup(table(spark, extra=extra)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=lambda r: (key(r[0]), r[4]))
    want = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        best = max(same, key=key)
        want.append((i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (key(r[0]), r[4]))
    assert exact_dedup(table(spark, [])).count() == 0


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    for t in [None, "", "One", "A b C d", prose(3, 200), "x\x0by\x0cz\x1cw É q", prose(2, 30000)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, least[find(i)]) for i, (d, _) in enumerate(rows)), key=lambda r: (key(r[0]), key(r[1])))


def near_rows():
    rng, rows = random.Random(4), []
    for g in range(6):
        words = prose(g, 300).split()
        for _ in range(6):
            copy = words[:]
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("rows", [None, near_rows()])
def test_near_duplicates(spark, rows):
    df = table(spark, rows, extra=rows is None)
    pairs = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=lambda r: (key(r[0]), key(r[1])))
    assert got == brute_components(pairs)


def test_near_pairs_are_complete(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64)) for b in base for n in (1, 2, 3, 4, 5)]
    fps = np.unique(np.r_[base, np.array(flips, np.uint64), np.uint64(0), np.uint64((1 << 64) - 1)])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for distance, parts in ((4, 2), (4, 3), (4, 4), (4, 5), (3, 2)):
        got = sorted((r["a"], r["b"]) for r in simhash.near_pairs(df, distance, parts).collect())
        want = sorted((min(a, b), max(a, b)) for i, a in enumerate(fps.view(np.int64).tolist()) for b in fps.view(np.int64)[:i].tolist() if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance)
        assert got == want


def test_segments_follow_the_number_of_fingerprints(spark):
    assert simhash.best_parts(10) == simhash.best_parts(10**6) == 3 and simhash.best_parts(10**9) == 2 and simhash.best_parts(10**12) == 2
    df, got = table(spark, near_rows()), []
    for parts in (2, 3, 5):
        got.append(sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df, parts=parts).collect()))
    assert got[0] == got[1] == got[2]


def test_rows_go_by_id_and_text(spark):
    """A row that shares only its doc_id with a near copy stays; clashing columns keep their values."""
    df = table(spark, [(1, prose(1, 90)), (2, prose(1, 90)), (2, prose(77, 90)), (3, prose(50, 90))])
    for c in ("_gone", "_hit", "gone_id", "gone_text", "th", "fp"):
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["_gone"], r["th"]) for r in kept.collect()) == sorted((i, prose(s, 90), f"_gone{i}", f"th{i}") for i, s in ((1, 1), (2, 77), (3, 50)))


def test_near_query_equals_brute_force(spark, sf_dir):
    from tamarack.llm import queries

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op4_simhash(spark, sf_dir).collect()
    texts = dict(rows)
    assert all(r["fingerprint"] == f"{brute_fingerprint(texts[r['doc_id']]):016x}" for r in got)
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == brute_components(rows)


def test_keep_one_per_group(spark):
    df = table(spark, near_rows() + [(None, "alone here"), (50, None)])
    kept = simhash.keep_one_per_group(df)
    least = {c for _, c in brute_components([(r["doc_id"], r["text"]) for r in df.collect()])}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == least | {None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(df.limit(0)).count() == 0


PASSAGE = "This passage has many words in it. It goes on for a while so that it counts. And then it ends here at last."


def split(t):
    """Lines by the documented rule."""
    import re

    whole = re.split("(?<=\n)|(?<=[.!?] )", t or "")
    return [x for w in whole for x in (re.split("(?<=, )", w) if len(w.encode()) > 150 else [w]) if x]


def brute_line_dedup(rows, width=3, least=1):
    """Windows as tuples of trimmed lines, later occurrences covered."""
    texts = sorted({(d, t) for d, t in rows}, key=lambda r: (r[0] is None, key(r[0])))
    seen, cover = set(), {}
    for d, t in texts:
        lines = split(t)
        real = [i for i, x in enumerate(lines) if x.strip()]
        starts = range(max(1, len(real) - width + 1)) if real else []
        mine = []
        for s in starts:
            part = real[s : s + width]
            w = tuple(lines[i].strip(" \n\r\t") for i in part)
            if sum(len(x.split()) for x in w) >= least:
                if w in seen:
                    cover.setdefault((d, t), set()).update(range(part[0], part[-1] + 1))
                mine.append(w)
                seen.add(w)
    out = []
    for d, t in rows:
        c = cover.get((d, t))
        out.append((d, t if c is None else "".join(x for i, x in enumerate(split(t)) if i not in c).rstrip(" "), len(c or ())))
    return out


def line_rows():
    return [(1, f"Intro one is here. {PASSAGE} The end of one."), (2, f"Two starts so. Then. {PASSAGE}\nTail two."), (3, f"{PASSAGE} {PASSAGE}"), (4, "A. B. C. D."), (5, "A. B. C. E."), (6, None), (7, ""), (None, f"Null id. {PASSAGE}"), (9, "\n\n \n")]


@pytest.mark.parametrize("extra", [False, True])
def test_line_dedup(spark, extra):
    df = table(spark, line_rows(), extra)
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    order = lambda r: (key(r[0]), str(r[1]), r[2])
    got = sorted(((r["doc_id"], r["text"], r["n_lines_removed"]) for r in out.collect()), key=order)
    assert got == sorted(brute_line_dedup(line_rows()), key=order)
    assert sum(PASSAGE in (t or "") for _, t, _ in got) == 1


def test_line_dedup_drops_emptied_only_on_request(spark):
    rows = [(1, PASSAGE), (2, PASSAGE), (3, ""), (4, None)]
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table(spark, rows)).collect()} == {1: PASSAGE, 2: "", 3: "", 4: None}
    assert {r["doc_id"] for r in line_dedup.line_dedup(table(spark, rows), drop_emptied=True).collect()} == {1, 3, 4}
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_line_dedup_on_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = sorted((r["doc_id"], r["text"], r["n_lines_removed"]) for r in line_dedup.line_dedup(docs).collect())
    assert got == sorted(brute_line_dedup([tuple(r) for r in docs.collect()]))


def brute_runs(rows, width=3, least=1):
    """Every window is looked for; covered lines go if the run of overlapping windows they are in has `least` words."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, key(r[0]))):
        lines, runs = split(t), []
        real = [i for i, x in enumerate(lines) if x.strip()]
        for s in range(max(1, len(real) - width + 1)) if real else []:
            part = real[s : s + width]
            if (w := tuple(lines[i].strip(" \n\r\t") for i in part)) in seen:
                if runs and part[0] <= runs[-1][1]:
                    runs[-1][1] = part[-1]
                else:
                    runs.append([part[0], part[-1]])
            seen.add(w)
        gone = {i for a, b in runs if len("".join(lines[a : b + 1]).split()) >= least for i in range(a, b + 1)}
        out[d, t] = (d, "".join(x for i, x in enumerate(lines) if i not in gone).rstrip(" ") if gone else t, len(gone))
    return [out[r] for r in rows]


def test_short_sentences_are_deduplicated_whole(spark, tmp_path, sf_dir):
    """op5 and the pipeline find a copy whose every window is under ten words, and leave runs of few words alone."""
    import corpus_pipeline
    from tamarack.llm import queries

    short = " ".join(f"{w.capitalize()} {i}!" for i, w in enumerate(prose(3, 60).split()))
    menu = "Home\nAbout\nContact\n"
    rows = [(1, short), (2, short), (3, f"Own start is here. {short} Own end."), (4, "A. B. C. D."), (5, "A. B. C. E."), (6, None), (7, ""), (8, menu), (9, menu + "One."), (10, "\x01" + menu)] + [(i, t) for i, t in line_rows() if i is None]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert {d: (r["n_lines_removed"], r["text_md5"]) for d, r in got.items()} == {d: (n, None if t is None else hashlib.md5(t.encode()).hexdigest()) for d, t, n in brute_runs(rows)}
    assert got[2]["n_chars_left"] == 0 and got[5]["n_lines_removed"] == 3 and got[9]["n_chars_left"] == 4
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, table(spark, rows), str(tmp_path)).collect()}
    assert 2 not in left and sum("Home\nAbout\nContact" in (t or "") for t in left.values()) == 2  # of 10 the first line differs
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for least in (1, 10):  # a floor on runs is a caller's choice
        got = sorted((r["doc_id"], r["text"], r["n_lines_removed"]) for r in line_dedup.line_dedup(docs, run_words=least).collect())
        assert got == sorted(brute_runs([tuple(r) for r in docs.collect()], least=least))


@pytest.mark.parametrize("mark", ["", "\x01"])
def test_a_passage_of_long_sentences_within_other_text(spark, mark):
    """Fifty-odd words in two sentences that run on into other text on both sides: whole lines within them go."""
    plain = lambda tag, n: " ".join(f"{tag}word{i}" for i in range(n))
    clauses = [plain(f"{chr(97 + i)}", 9) for i in range(6)]
    passage = f"{', '.join(clauses[:3])}. {', '.join(clauses[3:])}"
    around = lambda i: f"{mark}Own start {plain(f"left{i}", 12)} {passage} {plain(f"right{i}", 12)} own end."
    rows = [(1, around(1)), (2, around(2)), (3, "Short, of, commas."), (4, "Short, of, commas, too.")]
    got = {r["doc_id"]: (r["doc_id"], r["text"], r["n_lines_removed"]) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert sorted(got.values()) == brute_line_dedup(rows)
    assert got[1][1] == rows[0][1] and got[2][2] == 4 and all(c not in got[2][1] for c in clauses[1:5])
    assert got[3][2] == got[4][2] == 0


def test_line_dedup_carries_columns_of_any_name(spark):
    """Columns with the names the operator once used for itself come through with their values."""
    names = ["_text", "_cov", "_l", "_new", "_sd", "_st", "_spans", "spans", "lines", "runs", "n", "new", "th", "c0", "Text2"]
    rows = line_rows()
    df = table(spark, rows)
    for i, c in enumerate(names):
        df = df.withColumn(c, F.concat(F.lit(f"{c}-{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = line_dedup.line_dedup(df, drop_emptied=True)
    assert out.columns == [*df.columns, "n_lines_removed"]
    want = {r["doc_id"]: tuple(r[c] for c in names) for r in df.collect()}
    got = out.collect()
    assert len(got) > 5 and all(tuple(r[c] for c in names) == want[r["doc_id"]] for r in got)


def test_line_dedup_of_a_very_long_text(spark):
    text = prose(5, 60_000)
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(table(spark, [(1, text), (2, text + " own end."), (3, "x" * 2_000_000)])).collect()}
    assert got[1]["text"] == text and got[3]["n_lines_removed"] == 0 and got[2]["text"].endswith("own end.") and got[2]["n_lines_removed"] > 8000


def test_hot_line(spark):
    rows = [(i, f"{PASSAGE} Own line number {i} of this text. {prose(i, 20)}") for i in range(200)]
    out = line_dedup.line_dedup(table(spark, rows)).filter(F.col("text").contains("many words")).collect()
    assert [r["doc_id"] for r in out] == [0]
