"""The thin queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import clustering, language_id, lm_scoring, merkle, mixing, quality_classifier, sharding, simhash, url_filter
from tamarack.llm import exact_dedup as exact
from tamarack.llm import line_dedup as lines
from tamarack.llm import quality_rules as rules
from tamarack.llm import sentencepiece_ops as pieces
from tamarack.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document: a row each, with a digest of its ids.

    A null text has one row, with nulls; a text with a single segmentation has one row.
    """
    out = pieces.sample_encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(), k=2)
    digests = out.select("doc_id", "round_trip", F.transform("ids", lambda x: F.struct(F.size(x).cast("long").alias("n_pieces"), F.xxhash64(x).alias("ids_hash"))).alias("d"), *pieces.NUMBERS)
    rows = digests.select("doc_id", "round_trip", F.posexplode_outer(F.arrays_zip("d", *pieces.NUMBERS)).alias("sample", "s"))
    return rows.select("doc_id", "sample", "s.d.n_pieces", "s.d.ids_hash", *(f"s.{c}" for c in pieces.NUMBERS), "round_trip")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_cutoffs(spark: SparkSession, sf_dir: str, copies: int = 50) -> DataFrame:
    """The cutoffs that would be certified if every labelled good document counted `copies` times.

    Small tables have too few labels for any bound, so op2's verdicts there are the base rules' alone; this query shows
    the bounds, the walk and the correction at work on tables of any size.
    """
    keep = [F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("(none)")).alias("stratum")]
    held = rules.holdout(rules.measures(table(spark, sf_dir, "documents"), keep), table(spark, sf_dir, "labels"))
    return rules.thresholds(held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages (there is no list among the tables): about half of the hosts are added on a
    day of 2024 by a digest of their name, most of these removed later, and some added again; so are some parent domains."""
    names = pages.select(F.explode(F.slice(url_filter.domains(url_filter.host(F.col("url"))), 1, 2)).alias("key")).distinct()
    digit = lambda a, n: F.conv(F.substring(F.md5("key"), a, n), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    added, gone, again = digit(1, 4) % 300, digit(5, 2) % 60 + 1, digit(7, 2) % 60 + 1
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(added).alias("at")),
        F.struct(F.when(digit(9, 1) < 12, "remove").otherwise("add").alias("action"), day(added + gone).alias("at")),
        F.struct(F.when(digit(10, 1) < 8, "add").otherwise("remove").alias("action"), day(added + gone + again).alias("at")),
    )
    kind = F.when(digit(11, 1) < 8, "malware").otherwise("spam")
    return names.filter(digit(12, 1) < 8).select("key", kind.alias("category"), F.explode(steps).alias("s")).select("key", "category", "s.action", "s.at")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the entries active on its day (a day of 2024 by page_id, as pages have no fetch time)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    out = url_filter.judge(captures, listed_hosts(pages))
    return out.select("page_id", "host", "blocked", "matched_key", "category", F.col("listed_since").cast("string").alias("listed_since"), "n_active")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines_removed", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.target_ids(table(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded from the document as tampered with: newlines are gone where crc32(doc_id) is even."""
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    hurt = fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    leaf = merkle.digest_of(list(fields.values()))
    claim = F.when(even & F.contains("text", F.lit("\n")), merkle.digest_of(list(hurt.values()))).otherwise(leaf)
    proofs = merkle.verify(merkle.prove(merkle.build(docs, leaf, "source", "doc_id", claim)))
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digests(clustering.lloyd(table(spark, sf_dir, "embeddings"), k=40, rounds=5))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _quality_rules_sql(risk: float = 0.02, delta: float = 0.05, copies: int = 1) -> str:
    grid = ", ".join(f"('{r.name}', {i}, {c}::double)" for r in rules.RULES for i, c in enumerate(r.grid))
    values = " union all ".join(f"select doc_id, stratum, base_failed, '{r.name}' as rule, ({r.measure})::double as value from base" for r in rules.RULES)
    p, m = risk / len(rules.RULES), len(rules.RULES)
    word, count = "[^\\x20\\x09-\\x0D]", "count(*)::bigint"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '(none)') as stratum from documents),
w as (select *, regexp_extract_all(t, '{word}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) as ls from d),
wins as (select rid, i, array_to_string(ws[i:i + 4], ' ') as win from w, unnest(range(1, len(ws) - 3)) as r(i)),
twice as (select rid, i from wins qualify count(*) over (partition by rid, win) > 1),
cover as (select rid, count(distinct i + k)::bigint as n from twice, range(0, 5) as s(k) group by rid),
base0 as (select w.rid, doc_id, stratum, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words
  from w left join cover using (rid)),
base as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from base0),
vals as ({values}),
good as (select distinct doc_id from labels where quality = 1),
grid(rule, step, cutoff) as (values {grid}),
cells as (select stratum, rule, step, cutoff, ({count} * {copies})::bigint as n, (count(*) filter (where value > cutoff) * {copies})::bigint as k
  from vals join grid using (rule) where not base_failed and doc_id in (select doc_id from good) group by all),
tests as (select stratum, rule, step, cutoff, n, k, (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) from range(0, k + 1) as s(i)) as p_value,
  count(distinct stratum) over () as strata from cells),
marked as (select *, (k < n * {p} and p_value <= {delta} / (strata * {m})) as passed from tests),
stops as (select stratum, rule, coalesce(min(step) filter (where not passed), 1000) as stop from marked group by all),
cuts as (select m.stratum, m.rule, min(m.cutoff) as cutoff from marked m join stops s on m.stratum = s.stratum and m.rule = s.rule and m.step < s.stop group by all),
fails as (select distinct b.rid from base b join vals v on v.doc_id = b.doc_id join cuts c on c.stratum = b.stratum and c.rule = v.rule where v.value > c.cutoff)
{"select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and rid not in (select rid from fails)) as kept from base" if copies == 1 else "select stratum, rule, cutoff from cuts"}
"""


def _line_dedup_sql() -> str:
    """Windows compared as text; the first occurrence is the least (doc_id, place)."""
    marked = "t"
    for end in lines.ENDS:
        shown = end.replace("\n", "' || chr(10) || '")
        marked = f"replace({marked}, '{shown}', '{shown}' || chr(1))"
    blank = "' ' || chr(10) || chr(13) || chr(9)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, flatten(list_transform(string_split({marked}, chr(1)), lambda x: case when strlen(x) > {lines.LONG} then string_split(replace(x, '{lines.LONG_END}', '{lines.LONG_END}' || chr(1)), chr(1)) else [x] end)) as ls from d where t <> ''),
l as (select doc_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from s),
r as (select doc_id, i, trim(x, {blank}) as x from l where trim(x, {blank}) <> ''),
w as (select doc_id, i, row_number() over o as k, count(*) over (partition by doc_id) as m, x as a, lead(x, 1) over o as b, lead(x, 2) over o as c, coalesce(lead(i, 2) over o, lead(i, 1) over o, i) as e
  from r window o as (partition by doc_id order by i)),
later as (select doc_id, i, e from (select *, row_number() over (partition by a, b, c order by doc_id, i) as n from w where k <= greatest(m - 2, 1)) where n > 1),
gone as (select distinct doc_id, unnest(range(i, e + 1)) as i from later),
left_over as (select l.doc_id, count(g.i)::bigint as n, rtrim(coalesce(string_agg(case when g.i is null then x end, '' order by l.i), ''), ' ') as x from l left join gone g on l.doc_id = g.doc_id and l.i = g.i group by l.doc_id having count(g.i) > 0)
select doc_id, coalesce(n, 0)::int as n_lines_removed, length(case when n > 0 then x else text end)::bigint as n_chars_left, md5(case when n > 0 then x else text end) as text_md5 from documents left join left_over using (doc_id)"""


def _merkle_sql() -> str:
    """Levels by recursion; a proof's siblings by looking up the ancestors' runs; a fold over each leaf's levels."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {field(text)})"
    # bytes are entered as 256 and more, each with eight zeros behind it, for the shifts
    crc = "list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [256 + ascii(s[i]), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[])), lambda c, x: case when x > 0 then xor(c, x - 256) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, 4294967295::bigint)"
    tree = lambda name, base: f"{name}(g, lvl, i, n, d) as ({base} union all select g, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' order by i)) from {name} where n > 1 group by g, lvl, i // 3, n)"
    return f"""
with recursive docs as (select row_number() over () as rid, *, doc_id::varchar as s from documents),
crcs as (select rid, xor({crc}, 4294967295) as crc from docs where s is not null),
claims as (select rid, doc_id, source, {leaf('text')} as leaf, case when crc % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf('text')} end as claim from docs left join crcs using (rid)),
groups as (select source, row_number() over (order by source nulls first) - 1 as g, count(*) over () as k from (select distinct source from documents)),
leaves as (select rid, doc_id, leaf, claim, g, k, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from claims join groups on claims.source is not distinct from groups.source),
{tree('own', 'select g, 0, i, n, leaf from leaves')},
subs as (select g, lvl as height, d as subroot from own where n = 1),
{tree('top', 'select 0::bigint, 0, g, (select count(*) from subs), subroot from subs')},
roots as (select d as root, lvl as height from top where n = 1),
steps as (
  select rid, o.lvl as lv, string_agg(case when o.i < l.i // (3 ** o.lvl)::bigint then o.d end, '' order by o.i) as pre, string_agg(case when o.i > l.i // (3 ** o.lvl)::bigint then o.d end, '' order by o.i) as post
  from (select rid, g, i, unnest(range(0, height)) as lvl from leaves join subs using (g)) l join own o on o.g = l.g and o.lvl = l.lvl and o.i // 3 = (l.i // (3 ** l.lvl)::bigint) // 3 group by rid, o.lvl
  union all
  select rid, height + t.lvl, string_agg(case when t.i < l.g // (3 ** t.lvl)::bigint then t.d end, '' order by t.i), string_agg(case when t.i > l.g // (3 ** t.lvl)::bigint then t.d end, '' order by t.i)
  from (select rid, g, subs.height, unnest(range(0, roots.height)) as lvl from leaves join subs using (g) cross join roots) l join top t on t.lvl = l.lvl and t.i // 3 = (l.g // (3 ** l.lvl)::bigint) // 3 group by rid, height, t.lvl),
proofs as (select rid, list(coalesce(pre, '') order by lv) as pres, list(coalesce(post, '') order by lv) as posts, string_agg(coalesce(pre, '') || coalesce(post, ''), '' order by lv) as said from steps group by rid),
folds as (select rid, 0 as lv, claim as d from leaves union all select rid, lv + 1, sha256(pres[lv + 1] || d || posts[lv + 1]) from folds join proofs using (rid) where lv < len(pres)),
ends as (select rid, max_by(d, lv) as folded from folds group by rid)
select doc_id, leaf, subroot, root, sha256(coalesce(said, '')) as proof_sha256, folded as folded_root, folded = root as verified
from leaves join subs using (g) cross join roots left join proofs using (rid) join ends using (rid)"""


def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Components as rows: exact sums, and the nearest centroid by the least (distance, number)."""
    sql = f"""
with kept as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar) nulls last, v) - 1 as c, v from kept qualify c < {k}),"""
    near = lambda i: f"a{i} as materialized (select rid, min({{'d': d, 'c': c}}) as b from (select rid, c, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{i}) group by rid)"
    for i in range(rounds):
        sql += f"""
{near(i)},
m{i} as (select c, j, sum(x)::bigint as s, count(*) as n from (select b.c as c, unnest(v) as x, generate_subscripts(v, 1) as j from a{i} join kept using (rid)) group by c, j),
c{i + 1} as materialized (select c, coalesce(w, v) as v from c{i} left join (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as w from m{i} group by c) using (c)),"""
    return sql + f"""
{near(rounds)}
select vec_id, b.c::int as cluster, b.d as distance, (sum(b.d) over (partition by b.c))::bigint as cluster_inertia, (sum(b.d) over ())::bigint as inertia, sha256(array_to_string(c{rounds}.v, ',')) as centroid_sha256
from a{rounds} join kept using (rid) join c{rounds} on c = b.c"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "quality_cutoffs": quality_cutoffs,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_sharding": op13_sharding,
}

_HOST_SQL = f"nullif(lower(regexp_replace(regexp_extract(coalesce(url, ''), '{url_filter.HOST}', 1), '[.]+$', '')), '')"

ORACLES: dict[str, str] = {
    "op3_url_filter": f"""
with p as (select page_id, {_HOST_SQL} as host, (date '2024-01-01' + (page_id % 366)::int)::date as t from pages),
parents as (select host, t, unnest(range(1, case when regexp_matches(host, '{url_filter.ADDRESS}') then 2 else greatest(len(string_split(host, '.')) - 1, 1) + 1 end)) as i from (select distinct host, t from p where host is not null)),
keys as (select host, t, i, array_to_string(string_split(host, '.')[i:], '.') as key from parents),
names as (select distinct key from keys where i <= 2),
dig as (select key, md5(key) as m from names),
nums as (select key, ('0x' || substr(m, 1, 4))::int % 300 as a, ('0x' || substr(m, 5, 2))::int % 60 + 1 as g, ('0x' || substr(m, 7, 2))::int % 60 + 1 as r,
  ('0x' || substr(m, 9, 1))::int as d9, ('0x' || substr(m, 10, 1))::int as d10, ('0x' || substr(m, 11, 1))::int as d11 from dig where ('0x' || substr(m, 12, 1))::int < 8),
entries as (select key, case when d11 < 8 then 'malware' else 'spam' end as category, 'add' as action, (date '2024-01-01' + a)::date as dt from nums
  union all select key, case when d11 < 8 then 'malware' else 'spam' end, case when d9 < 12 then 'remove' else 'add' end, (date '2024-01-01' + a + g)::date from nums
  union all select key, case when d11 < 8 then 'malware' else 'spam' end, case when d10 < 8 then 'add' else 'remove' end, (date '2024-01-01' + a + g + r)::date from nums),
spans as (select *, lead(dt) over (partition by key, category order by dt, action) as til from entries),
valid as (select key, category, dt as since, til from spans where action = 'add' and (til is null or til > dt)),
hits as (select k.host, k.t, k.i, k.key, v.category, v.since, row_number() over (partition by k.host, k.t order by k.i, v.since desc, v.category) as rn, (count(*) over (partition by k.host, k.t))::bigint as n
  from keys k join valid v on k.key = v.key and v.since <= k.t and (v.til is null or k.t < v.til))
select page_id, p.host, h.key is not null as blocked, h.key as matched_key, h.category, h.since::varchar as listed_since, coalesce(h.n, 0)::bigint as n_active
from p left join hits h on h.host = p.host and h.t = p.t and h.rn = 1""",
    "op2_quality_rules": _quality_rules_sql(),
    "quality_cutoffs": _quality_rules_sql(copies=50),
    "op5_line_dedup": _line_dedup_sql(),
    "op8_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, (count(*) over w)::bigint as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_centroid_clustering": _lloyd_sql(),
}
