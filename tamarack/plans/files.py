"""Sources and sinks: tables are written as the files of a source, and its reader must give them back."""

from pyspark.sql import functions as F

from tamarack import schema
from tamarack.functions import urls
from tamarack.operators import records
from tamarack.plans.registry import plan
from tamarack.session import scratch, table
from tamarack.sources import readers, sinks, store, workbooks


def _lines(df, spark, tag):
    """A column of text lines as files."""
    path = scratch(spark, tag)
    df.write.text(path)
    return path


def _named_files(df, spark, tag):
    """A file for every row (path, body), as trees of small files come; the executors write them."""
    top = scratch(spark, tag)
    store.write_files(df.toDF("name", "body"), top)
    return top


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"


@plan(f"select page_id::varchar as timestamp, {_HOST} as source, '2024-01-01' as date, url as link from pages")
def read_links(spark, sf_dir):
    """A link queue with stray blanks around its fields."""
    p = table(spark, sf_dir, "pages").select(F.concat_ws("\t", F.concat(F.col("page_id").cast("string"), F.lit(" ")), urls.host(F.col("url")), F.lit(" 2024-01-01"), F.col("url")).alias("value"))
    return readers.links(spark, _lines(p, spark, "links"))


@plan(f"select {_HOST} as source, url as link, count(*)::bigint as n from pages group by all")
def read_collected_links(spark, sf_dir):
    """Rows of three and of four fields, counted from the end."""
    p = table(spark, sf_dir, "pages").select(F.concat_ws("\t", F.when(F.col("page_id") % 2 == 0, "20240101"), urls.host(F.col("url")), F.lit("2024-01-01"), F.col("url")).alias("value"))
    return readers.collected_links(spark, _lines(p, spark, "collected")).groupBy("source", "link").agg(F.count(F.lit(1)).alias("n"))


@plan("select page_id::varchar as timestamp, case when page_id % 2 = 0 then '2' else '1' end as date, url as link from pages")
def read_link_facts(spark, sf_dir):
    """The collected queue overrides the waiting one."""
    p = table(spark, sf_dir, "pages")
    line = lambda rows, date: _lines(rows.select(F.concat_ws("\t", F.col("page_id").cast("string"), F.lit("s"), F.lit(date), F.col("url")).alias("value")), spark, "facts")
    return readers.link_facts(spark, line(p, "1"), line(p.filter("page_id % 2 = 0"), "2")).select("timestamp", "date", "link")


@plan("select 'region' || n_regionkey as source, 'm' || (n_nationkey % 2) as model, 'cot' as prompt, '20240101_000000_' || lpad(n_nationkey::varchar, 6, '0') || '_verify.json' as file, '[{\"Package Name\": \"' || n_name || '\"}]' as text from nation")
def read_model_outputs(spark, sf_dir):
    """Files of one step below source/model/prompt; those of other steps stay unread."""
    name = F.concat(F.lit("20240101_000000_"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0"))
    folder = F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("/m"), (F.col("n_nationkey") % 2).cast("string"), F.lit("/cot/"))
    body = F.concat(F.lit('[{"Package Name": "'), F.col("n_name"), F.lit('"}]'))
    files = table(spark, sf_dir, "nation").select(F.explode(F.array(F.struct(F.concat(folder, name, F.lit("_verify.json")).alias("p"), body.alias("b")), F.struct(F.concat(folder, name, F.lit("_extract.json")).alias("p"), F.lit("[]").alias("b")))).alias("f")).select("f.*")
    return readers.model_outputs(spark, _named_files(files, spark, "outputs")).select("source", "model", "prompt", "file", "text")


@plan("select 'm' || (s_nationkey % 3) as model, 'rel' || (s_suppkey % 2) as state, '20240101_000000_' || lpad(s_suppkey::varchar, 6, '0') || '_relation_x.json' as file, '{\"s\": ' || s_suppkey || '}' as text from supplier")
def read_relation_outputs(spark, sf_dir):
    """Files of the relation step below model/state, among those of other steps."""
    k = F.col("s_suppkey").cast("string")
    at = F.concat(F.lit("m"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/rel"), (F.col("s_suppkey") % 2).cast("string"), F.lit("/20240101_000000_"), F.lpad(k, 6, "0"))
    each = F.array(F.struct(F.concat(at, F.lit("_relation_x.json")).alias("p"), F.concat(F.lit('{"s": '), k, F.lit("}")).alias("b")), F.struct(F.concat(at, F.lit("_verify_x.json")).alias("p"), F.lit("[]").alias("b")))
    files = table(spark, sf_dir, "supplier").select(F.explode(each).alias("f")).select("f.*")
    return readers.model_outputs(spark, _named_files(files, spark, "relations"), "relation", ("model", "state")).select("model", "state", "file", "text")


_CELL = "'<' || c_name || '> & \"' || c_custkey || '\"' || chr(10) || ' _x0041_ '"


@plan(f"select 'part' || (c_custkey // 400) as book, 'customers' as sheet, c_custkey::varchar as c_custkey, {_CELL} as text, case when c_custkey % 5 > 0 then c_mktsegment end as segment, (date '1999-12-25' + (c_custkey % 900)::int)::date::varchar as day, case when c_custkey % 2 = 0 then 'TRUE' else 'FALSE' end as even, null::varchar as absent from customer")
def read_workbooks(spark, sf_dir):
    """Customers written as workbooks of 400 rows and read back: shared and escaped text, empty cells, dates, booleans."""
    top, k = scratch(spark, "books"), F.col("c_custkey")
    text = F.concat(F.lit("<"), "c_name", F.lit('> & "'), k.cast("string"), F.lit('"\n _x0041_ '))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("part"), F.floor(k / 400).cast("string")).alias("book"), "c_custkey", text.alias("text"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("segment"),
        F.date_add(F.lit("1999-12-25").cast("date"), (k % 900).cast("int")).alias("day"), (k % 2 == 0).alias("even"),
    )
    columns = ["c_custkey", "text", "segment", "day", "even"]
    workbooks.write_workbooks(rows, top, "book", "c_custkey", columns, "customers")
    out = workbooks.sheet_table(workbooks.workbooks(spark, top, "customers"), [*columns, "absent"])
    return out.withColumn("book", F.regexp_replace("file", "\\.xlsx$", "")).drop("file", "row")


@plan("select r_name as source, count(*)::bigint as n_files, sum(length(n_name))::bigint as bytes from nation join region on r_regionkey = n_regionkey group by 1")
def read_documents_status(spark, sf_dir):
    """A folder of text files, and how many and how large they are by source."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    files = n.select(F.concat("r_name", F.lit("/20240101_000000_"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.lit(".txt")), "n_name")
    out = readers.status(readers.documents(spark, _named_files(files, spark, "docs"))).drop("last_modified")
    return out.withColumn("source", F.replace("source", F.lit("%20"), F.lit(" ")))


@plan("select n_nationkey::int as k, n_name as name from nation")
def read_json_array(spark, sf_dir):
    """One JSON array written as a document, read as a row per element."""
    doc = sinks.json_document(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    rows = readers.json_array(spark, _lines(doc, spark, "array"))
    return rows.select(F.try_variant_get("record", "$.n_nationkey", "int").alias("k"), F.try_variant_get("record", "$.n_name", "string").alias("name"))


@plan("select s_name as name, s_suppkey::varchar as version, '2024' as upload_time from supplier")
def read_json_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    sinks.overwrite_json(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("version"), F.lit("2024").alias("upload_time")), path)
    return readers.json_lines(spark, path)


@plan("select case when n_nationkey % 2 = 0 then 'npm' else 'pypi' end as manager, coalesce(x, 'NA') as name, '2024-05-01' as published from nation, unnest([lower(n_name), null]) as t(x)")
def read_advisories(spark, sf_dir):
    """manager/package/*.json, a row per affected package; one without a name is NA."""
    folder = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "npm").otherwise("pypi"), F.lit("/p"), F.col("n_nationkey").cast("string"), F.lit("/MAL.json"))
    body = F.concat(F.lit('{"published": "2024-05-01T10:00:00Z",\n"affected": [{"package": {"name": "'), F.lower("n_name"), F.lit('"}}, {"package": {}}]}'))
    return readers.advisories(spark, _named_files(table(spark, sf_dir, "nation").select(folder, body), spark, "osv"))


@plan("select lower(n_name) as name, case when n_nationkey % 3 = 0 then 'NA' else '2024-01-02T00:00:00Z' end as created from nation")
def read_registry_pages(spark, sf_dir):
    """Registry answers: plain JSON, and HTML with the JSON in a paragraph."""
    k = F.col("n_nationkey")
    json = F.concat(F.lit('{"name": "'), F.lower("n_name"), F.when(k % 3 == 0, '"}').otherwise('", "time": {"created": "2024-01-02T00:00:00Z"}}'))
    body = F.when(k % 2 == 0, json).otherwise(F.concat(F.lit("<html><p>"), json, F.lit("</p></html>")))
    return readers.registry_pages(spark, _named_files(table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), k.cast("string")), body), spark, "registry"))


@plan("select c_custkey::varchar as c_custkey, c_name, c_mktsegment, count(*)::bigint as n from customer, range(0, 2) group by all")
def append_and_read_csv(spark, sf_dir):
    """Rows appended twice, each file with its header, chosen columns in order."""
    path, c = scratch(spark, "csv"), table(spark, sf_dir, "customer")
    for _ in range(2):
        sinks.append_csv(c, path, ["c_custkey", "c_name", "c_mktsegment"])
    return readers.csv_table(spark, path).groupBy("c_custkey", "c_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@plan("select p_partkey::varchar as package, 'café, \"' || p_name || '\"' as ref_name, 'http://x/' || p_partkey as first_url from part")
def read_latin_csv(spark, sf_dir):
    """A positional CSV in Latin-1, with quotes and commas inside fields."""
    path = scratch(spark, "latin")
    cols = ["manager", "package", "advisory_url", "ref_index", "ref_name", "first_url", "second_urls"]
    row = {"package": F.col("p_partkey").cast("string"), "ref_name": F.concat(F.lit('café, "'), F.col("p_name"), F.lit('"')), "first_url": F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))}
    table(spark, sf_dir, "part").select(*(row.get(c, F.lit("x")).alias(c) for c in cols)).write.option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return readers.advisory_links(spark, path).select("package", "ref_name", "first_url")


@plan("select 'npm' as manager, 'pkg' || page_id as package, url as link from pages")
def read_search_results(spark, sf_dir):
    path = scratch(spark, "search")
    row = {"manager": F.lit("npm"), "package": F.concat(F.lit("pkg"), F.col("page_id").cast("string")), "link": F.col("url")}
    cols = [c.split()[0] for c in schema.SEARCH_RESULTS.split(", ")]
    table(spark, sf_dir, "pages").select(*(row.get(c, F.lit("x")).alias(c) for c in cols)).write.option("escape", '"').csv(path)
    return readers.search_results(spark, path).select("manager", "package", "link")


@plan("select event_type as source, count(*)::bigint as n, sum(event_id)::bigint as total from events where event_type = 'click' group by 1")
def write_and_prune_outputs(spark, sf_dir):
    """Results in folders by their keys; a read of one key opens its folder alone."""
    path = scratch(spark, "results")
    sinks.outputs(table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "event_id"), path, ["source"])
    return spark.read.parquet(path).filter("source = 'click'").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@plan("select 'tweet:' || event_id as event_id, event_type from events")
def write_tagged_csv(spark, sf_dir):
    path = scratch(spark, "tagged")
    sinks.tagged_csv(table(spark, sf_dir, "events").select("event_id", "event_type"), path, "event_id", "tweet")
    return readers.csv_table(spark, path)


@plan("select word, count(*)::bigint as n from (values ('the'), ('of')) s(word) join (select unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) as word from documents) using (word) group by 1")
def read_word_list(spark, sf_dir):
    """A list of stop words from a file, counted in all documents."""
    words = spark.createDataFrame([("# stop words",), (" The ",), ("",), ("of",), ("of",)], "value string")
    listed = readers.word_list(spark, _lines(words, spark, "words"))
    tokens = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("word"))
    return tokens.join(F.broadcast(listed), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # the list is two words


@plan(f"""with h as (select page_id, string_split({_HOST}, '.') as l from pages), s as (select page_id, l, array_to_string(l[-2:], '.') as two from h)
select page_id, case when two in ('co.uk', 'org.test') or (len(l) > 1 and l[-1] = 'org' and two = 'org.test') then array_to_string(l[-3:], '.') when l[-2] is not null and l[-2] || '.' || l[-1] = (select min(d) from (select array_to_string(l[-2:], '.') as d from h)) then array_to_string(l[-3:], '.') else two end as domain from s""")
def domains_by_suffix_table(spark, sf_dir):
    """Registered domains by a table of public suffixes, one of which is the first of the pages' own domains."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    own = p.agg(F.min(urls.last_labels(F.col("url"))).alias("value"))
    listed = readers.word_list(spark, _lines(spark.createDataFrame([("// suffixes",), ("co.uk",), ("org.test",)], "value string").unionByName(own), spark, "suffixes"))
    return urls.under_suffixes(p, "url", listed).select("page_id", "domain")


@plan("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def registry_lookups(spark, sf_dir):
    """The point look-ups of many names as one semi join."""
    names = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return records.lookups(table(spark, sf_dir, "part"), names, "p_partkey").select("p_partkey", "p_name")


@plan("select event_type as name, count(*)::bigint as n from events where event_type <> 'view' and ts::date between (select min(ts)::date from events) and (select min(ts)::date from events) + 2 group by 1")
def downloads_three_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "ts")
    first = e.agg(F.to_date(F.min("ts"))).first()[0]
    return records.downloads(e, e.filter("name <> 'view'"), "ts", F.lit(first))


@plan("select page_id, (page_id * 7)::varchar as id from pages")
def first_article_id(spark, sf_dir):
    """The id of the first list entry in a page's scripts, else any id field."""
    k = (F.col("page_id") * 7).cast("string")
    listed = F.concat(F.lit('<script>self.push("x")</script><script>{"id": 1, "newsList":[{"t": 1,\n"id": "'), k, F.lit('"}, {"id": 3}]}</script>'))
    plain = F.concat(F.lit('<script>{"id": '), k, F.lit("}</script>"))
    return table(spark, sf_dir, "pages").select("page_id", readers.article_id(F.when(F.col("page_id") % 2 == 0, listed).otherwise(plain)).alias("id"))


@plan("select o_orderkey, count(*)::bigint as n, round(sum(l_quantity), 2)::double as quantity from orders join lineitem on o_orderkey = l_orderkey group by 1")
def cached_join(spark, sf_dir):
    """Orders and their lines kept as tables bucketed by order: their join and its groups move no row."""
    held = {}
    for name, key, columns in (("orders", "o_orderkey", ["o_orderkey"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])):
        path = scratch(spark, f"cache-{name}")
        at = f"cache_{path.rpartition('-')[2]}"
        held[name] = sinks.bucketed(table(spark, sf_dir, name).select(*columns), at, [key], 8, path)
    joined = held["orders"].hint("merge").join(held["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))
