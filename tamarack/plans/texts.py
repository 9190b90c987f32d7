"""Tokens, candidates, keywords, TF-IDF, chunks and triples."""

import re

from pyspark.sql import functions as F

from tamarack.functions import text, triples
from tamarack.functions.normalise import plausible_name
from tamarack.operators import factors, paragraphs, terms
from tamarack.plans.registry import plan
from tamarack.session import table
from tamarack.sources import agents


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_CAND = "list_distinct(list_transform(list_distinct(regexp_extract_all(text, '(?:@[a-zA-Z0-9\\-]+\\/)?[a-zA-Z0-9][a-zA-Z0-9\\._\\-]+')), lambda w: regexp_replace(w, '[.,]$', '')))"
_STOP = ["the", "of", "and", "to", "in"]
_STOP_SQL = "('the', 'of', 'and', 'to', 'in')"


@plan(f"select doc_id, len({_W})::int as n_words, len(list_distinct({_W}))::int as n_distinct from documents")
def word_tokens(spark, sf_dir):
    w = text.words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


@plan(f"select doc_id, array_to_string(list_sort(list_filter({_CAND}, lambda w: lower(w) not in {_STOP_SQL} and w not in ('The', 'That'))), ' ') as names from documents")
def candidates_per_doc(spark, sf_dir):
    names = text.candidates(F.col("text"), common=_STOP, stop=["The", "That"])
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(names), " ").alias("names"))


@plan(f"select w as name, count(*)::bigint as n_docs from (select unnest({_CAND}) as w from documents) group by w order by n_docs desc, name limit 25")
def candidate_top25(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.explode(text.candidates(F.col("text"))).alias("name"))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "name").limit(25)


_VOCABULARY = {"first": (5, ["the", "of", "supply chain"]), "second": (3, ["of", "and", "Gemfile"]), "third": (1, ["to", "la", "de", "die"])}


@plan(f"select doc_id, coalesce(list_sum(list_transform({_W}, lambda w: case when w in ('the', 'of') then 5 when w = 'and' then 3 when w in ('to', 'la', 'de', 'die') then 1 else 0 end)), 0)::bigint as score from documents")
def keyword_score(spark, sf_dir):
    """The first category that has a word gives its weight; several words or capitals never match."""
    return _docs(spark, sf_dir).select("doc_id", text.keyword_score(F.col("text"), text.keyword_weights(_VOCABULARY)).alias("score"))


@plan(f"select doc_id, (len(list_filter({_W}, lambda w: w = 'the')) * 5 + len(list_filter({_W}, lambda w: w = 'and')) * 3)::bigint as score from documents")
def keyword_score_join(spark, sf_dir):
    weights = spark.createDataFrame([("the", 5), ("and", 3)], "word string, weight int")
    return terms.keyword_hits(_docs(spark, sf_dir), "doc_id", text.words(F.col("text")), weights)


_TFIDF = """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term from documents), tf as (select doc_id, term, count(*) as tf from t group by all),
df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from documents),
r as (select doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n), l as (select doc_id, sqrt(sum(w * w)) as l from r group by 1), w as (select doc_id, term, w / l as w from r join l using (doc_id))"""


def _longer():
    return F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def _weights(spark, sf_dir, heaviest=None):
    return terms.tfidf(_docs(spark, sf_dir), "doc_id", _longer(), heaviest)


@plan(_TFIDF + " select term, round(sum(w), 4) as score from w group by 1 order by score desc, term limit 25")
def tfidf_top25(spark, sf_dir):
    return terms.corpus_top(_weights(spark, sf_dir))


@plan(_TFIDF + " select doc_id, term, round(w, 6) as w, row_number() over (partition by doc_id order by round(w, 6) desc, term)::int as rank from w qualify rank <= 10")
def tfidf_per_doc_top10(spark, sf_dir):
    return terms.document_top(_weights(spark, sf_dir, heaviest=10), "doc_id")


@plan(f"""with t as (select doc_id, unnest({_W}) as term, generate_subscripts({_W}, 1) as pos from documents), d as (select term, count(distinct doc_id)::bigint as df from t group by 1)
select doc_id, row_number() over (partition by doc_id order by df, pos)::int as rank, term, df from t join d using (term) qualify rank <= 25""")
def rarest_terms(spark, sf_dir):
    return terms.rarest(_docs(spark, sf_dir), "doc_id", text.words(F.col("text")))


_CLEAN = "list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '(?s)\\{.*?\\}', ' ', 'g'), '(?s)<.*?>', ' ', 'g'), ' '), '\\s+'), lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9@/_-]*'))"


@plan(f"select doc_id, len({_CLEAN})::int as n_tokens, md5(array_to_string({_CLEAN}, ' ')) as digest from documents")
def doc_tokens_clean(spark, sf_dir):
    t = text.name_like_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


@plan(f"select doc_id, len(list_filter(regexp_split_to_array(trim(lower(text), ' '), '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}+') and w not in {_STOP_SQL}))::int as n_tokens from documents")
def alpha_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(text.alpha_tokens(F.col("text"), _STOP)).alias("n_tokens"))


@plan("""with s as (select doc_id, list_reduce(string_split(text, chr(10)), lambda a, x: case when a.o = 0 then {'n': a.n, 'c': a.c, 'o': length(x)}
  when a.o + length(x) + 1 <= 600 then {'n': a.n, 'c': a.c, 'o': a.o + length(x) + 1} else {'n': a.n + 1, 'c': a.c + a.o, 'o': length(x)} end, {'n': 0::bigint, 'c': 0::bigint, 'o': 0::bigint}) as a from documents)
select doc_id, (a.n + case when a.o > 0 then 1 else 0 end)::int as n_chunks, (a.c + a.o)::int as n_chars from s""")
def chunk_greedy(spark, sf_dir):
    """Lines packed into chunks of 600 characters; the packing depends on what was packed before."""
    d = _docs(spark, sf_dir).select("doc_id", text.chunk(F.split("text", "\n"), 600).alias("chunks"))
    return d.select("doc_id", F.size("chunks").alias("n_chunks"), F.aggregate("chunks", F.lit(0), lambda s, c: s + F.length(c)).alias("n_chars"))


@plan("""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) as i from documents),
o as (select w, count(*) as n from t group by 1), p as (select a.w as a, b.w as b, count(*)::bigint as n_ab from t a join t b on a.doc_id = b.doc_id and b.i = a.i + 1 group by all),
s as (select a, b, n_ab, (n_ab - 1) * (select count(*) from o) / (x.n * y.n) as score from p join o x on x.w = a join o y on y.w = b)
select a, b, n_ab, round(score, 6) as score from s where score > 2""")
def bigram_phrases(spark, sf_dir):
    d = _docs(spark, sf_dir).select(text.words(F.col("text")).alias("w"))
    return text.bigrams(d, "w").withColumn("score", F.round("score", 6))


@plan("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int - 1 as pos from documents)
select doc_id, pos, md5(case when len(w) <= 4 then line else array_to_string(w[1:2], ' ') || ' ... ' || array_to_string(w[-2:], ' ') end) as short, md5(regexp_replace(line, '[^\\x20-\\x7E]', '', 'g')) as ascii from (select *, string_split(line, ' ') as w from l)""")
def abbreviate_and_ascii(spark, sf_dir):
    """Every line of every text, abbreviated and without what isn't ASCII (as digests)."""
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", F.md5(text.abbreviated(F.col("line"))).alias("short"), F.md5(text.printable(F.col("line"))).alias("ascii"))


@plan("select n_nationkey, 'UNITED KINGDOM x' as label, '@scope/name' as scoped, '\"' || n_name || '\" npm malicious package' as phrase from nation")
def name_rewrites(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.label(F.lit("UNITED_KINGDOM x")).alias("label"), text.scoped(F.lit("@scope##name")).alias("scoped"), text.search_phrase(F.col("n_name"), F.lit("npm")).alias("phrase"))


_TRIPLES = "concat('[SUBJECT:', lower(n_name), ', RELATION:', case n_nationkey % 4 when 0 then 'is' when 1 then 'steals' when 2 then 'published' else 'near' end, ', OBJECT:', case n_nationkey % 4 when 0 then 'malicious npm package' else 'sensitive data' end, '] and [SUBJECT:the x, RELATION:in,  OBJECT:', r_name, ']')"
_BUILT = f"select n_nationkey, {_TRIPLES} as t from nation join region on r_regionkey = n_regionkey"


def _triples(spark, sf_dir):
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return table(spark, sf_dir, "nation").join(F.broadcast(r), "n_regionkey").select("n_nationkey", F.expr(_TRIPLES).alias("t"))


@plan(f"""with b as ({_BUILT}), e as (select n_nationkey, unnest(regexp_extract_all(t, '\\[([^\\[\\],]*,[^\\[\\],]*,[^\\[\\],]*)\\]', 1)) as x from b),
p as (select n_nationkey, list_transform(string_split(x, ','), lambda s: trim(regexp_replace(trim(s), '^(?:SUBJECT|RELATION|OBJECT)\\s*:', ''))) as p from e)
select n_nationkey, p[1] as sub, p[2] as rel, p[3] as obj, trim(regexp_replace(concat_ws(' ', p[1], p[2], p[3]), ' +', ' ', 'g')) as sentence from p""")
def triples_parse(spark, sf_dir):
    rows = _triples(spark, sf_dir).select("n_nationkey", F.explode(triples.parts(F.col("t"))).alias("p")).select("n_nationkey", "p.*")
    return rows.withColumn("sentence", triples.sentence(F.col("sub"), F.col("rel"), F.col("obj")))


@plan(f"""with b as ({_BUILT}) select n_nationkey, case n_nationkey % 4 when 3 then array_to_string(list_sort([lower(n_name2), 'sensitive data', lower(r)]), '|') else lower(n_name2) end as names, case when n_nationkey % 4 = 0 then 'npm' else 'other' end as manager
from (select n_nationkey, regexp_extract(t, 'SUBJECT:([^,]+)', 1) as n_name2, regexp_extract(t, 'OBJECT:([A-Z ]+)\\]$', 1) as r from b)""")
def triple_packages(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return t.select("n_nationkey", F.array_join(triples.packages(F.col("t")), "|").alias("names"), triples.manager_guess(F.col("t")).alias("manager"))


@plan("select p_partkey, length(p_name) > 2 and regexp_full_match(p_name, '[a-zA-Z0-9_-]+') and p_name not in ('code') and not contains(p_name, 'fake') as ok from part")
def plausible_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", plausible_name(F.col("p_name"), ["code"], ["fake"]).alias("ok"))


_NAME_LISTS = ", ".join("regexp_extract_all(t, '" + p.replace("'", "''") + "', 1, 'i')" for p in triples.NAME_PATTERNS)


@plan(f"""with t as (select n_nationkey, 'Use "' || n_name || '" and library ' || n_name || '-kit version 1.' || n_nationkey || ', package ''pad'' or left-' || n_nationkey || '.2 v3' as t from nation),
n as (select n_nationkey, list_transform(flatten([{_NAME_LISTS}]), lambda x: lower(x)) as xs from t)
select n_nationkey, array_to_string(list_sort(list_distinct(list_filter(xs, lambda x: length(x) > 2 and x <> 'version'))), '|') as names from n""")
def names_in_prose(spark, sf_dir):
    """Package names in prose: quoted, before a version, or after `library` and `package`."""
    prose = F.concat(F.lit('Use "'), "n_name", F.lit('" and library '), "n_name", F.lit("-kit version 1."), F.col("n_nationkey").cast("string"), F.lit(", package 'pad' or left-"), F.col("n_nationkey").cast("string"), F.lit(".2 v3"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(triples.named_in_text(prose, never=["version"]), "|").alias("names"))


@plan()
def lda_topics(spark, sf_dir):
    """The shares of five topics in every document, and the leading one: all words in hashed columns, 50 rounds over all
    documents (as many passes as the reference makes), a fixed seed."""
    from tamarack.operators.models import lda_topics as lda

    d = _docs(spark, sf_dir).select("doc_id", text.words(F.col("text")).alias("w"))
    mixed, _ = lda(d, "doc_id", "w", iterations=50, columns=1 << 17, share=1.0)
    leading = F.expr("array_position(topics, array_max(topics)) - 1").cast("int")
    return mixed.select("doc_id", "topics", F.when(F.array_max("topics") > 0, leading).alias("leading"))


@plan()
def nmf_topics(spark, sf_dir):
    """Ten heaviest terms of five non-negative topics of the TF-IDF table, every term kept, both factors as tables."""
    return factors.top_terms(factors.factorise_blocks(terms.tfidf_blocks(_docs(spark, sf_dir), "doc_id", _longer()), rounds=8), 5).withColumn("weight", F.round("weight", 5))


@plan()
def paragraph_vectors(spark, sf_dir):
    """A vector of every document, under a word table learnt from all of them."""
    d, w = _docs(spark, sf_dir), text.words(F.col("text"))
    return paragraphs.infer(d, "doc_id", w, paragraphs.fit(d, w, epochs=2, passes=2), passes=8)


@plan()
def pca_embed(spark, sf_dir):
    """The first eight principal components of every vector."""
    from tamarack.operators.models import pca

    return pca(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", F.transform("components", lambda x: F.round(x, 4)).alias("components"))


@plan()
def one_class_vectors(spark, sf_dir):
    from tamarack.operators.models import one_class

    return one_class(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@plan("with m as (select avg(x) as m, i from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by i), v as (select list(m order by i) as m from m) select vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: x::double), m), 5) as similarity from embeddings, v")
def corpus_similarity(spark, sf_dir):
    """Every vector against the corpus mean; topic vectors of models.lda_topics go the same way."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return terms.corpus_similarity(e, "vec_id", "v").withColumn("similarity", F.round("similarity", 5))


@plan("select i::int - 1 as topic, round(avg(x), 6) as mean from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) group by i")
def mean_topics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return terms.mean_topics(e, "v").withColumn("mean", F.round("mean", 6))


@plan("select n_nationkey, '[1, 2]' as salvaged, '{\"a\": 1}' as fence, '{\"b\": 2}' as inner_fence, lower(n_name) as advisory, n_name as name, '1.' || n_nationkey as version from nation")
def model_text(spark, sf_dir):
    """What models and feeds wrap around names and JSON, taken off."""
    n = table(spark, sf_dir, "nation")
    fenced = F.lit('```json\n{"a": 1}\n```')
    both = F.lit('Here you are:\n```json\n// a comment\n{"b": 2}\n```\nDone.')
    pair = text.name_and_version(F.concat(F.lit("  "), F.col("n_name"), F.lit("  1."), F.col("n_nationkey").cast("string"), F.lit(" later")))
    return n.select(
        "n_nationkey", text.bracketed(F.lit("Sure: [1, 2] and so on")).alias("salvaged"), text.without_fence(fenced).alias("fence"), text.without_comments(both).alias("inner_fence"),
        text.advisory_name(F.concat(F.lit("Malicious code in "), F.lower("n_name"), F.lit(" (npm)"))).alias("advisory"), pair["name"].alias("name"), pair["version"].alias("version"),
    )


class _Patterns:
    """A client by rules: numbers, and words in capitals."""

    KINDS = {"number": "[0-9]+", "capitals": "\\b[A-Z][A-Z]+\\b"}

    def entities(self, part):
        return [(m.start(), m.end(), k) for k, p in self.KINDS.items() for m in re.finditer(p, part, re.ASCII)]


@plan("""with f as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as e, 'number' as kind from documents union all select doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][A-Z]+\\b')), 'capitals' from documents)
select doc_id, kind, count(*)::bigint as n, sum(length(e))::bigint as n_chars from f group by all""")
def entities_in_parts(spark, sf_dir):
    """Entities of whole texts read in overlapping parts of 500 characters, as many and as long as in the texts at once."""
    found = agents.entity_spans(_docs(spark, sf_dir), _Patterns(), "doc_id", most=500, overlap=60)
    return found.filter("error is null").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("entity")).alias("n_chars"))
