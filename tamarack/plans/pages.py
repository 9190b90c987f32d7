"""URLs and HTML."""

import re

from pyspark.sql import functions as F

from tamarack.functions import html, pagetree, urls
from tamarack.operators import stats
from tamarack.plans.registry import plan
from tamarack.session import table
from tamarack.sources import extract

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_DOMAIN = f"array_to_string(string_split({_HOST}, '.')[-2:], '.')"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _domains(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.when(F.col("page_id") % 2 == 0, "npm").otherwise("pypi").alias("manager"), urls.registered_domain(F.col("url")).alias("domain"))


@plan(f"select {_DOMAIN} as domain, count(*)::bigint as n from pages group by 1")
def page_domain_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy(urls.last_labels(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@plan(f"select case when page_id % 2 = 0 then 'npm' else 'pypi' end as manager, {_DOMAIN} as domain, grouping(case when page_id % 2 = 0 then 'npm' else 'pypi' end)::bigint as overall, count(*)::bigint as n from pages group by grouping sets ((case when page_id % 2 = 0 then 'npm' else 'pypi' end, {_DOMAIN}), ({_DOMAIN}))")
def domain_grouping_sets(spark, sf_dir):
    return stats.grouped_domains(_domains(spark, sf_dir), "manager", "domain")


@plan(f"with c as (select {_DOMAIN} as domain, case when page_id % 2 = 0 then 'npm' else 'pypi' end as manager, count(*) as n from pages group by all) select domain, string_agg(manager || '=' || n::varchar, ',' order by manager) as counts from c group by 1")
def domain_manager_map(spark, sf_dir):
    per = stats.counts(_domains(spark, sf_dir), "domain", "manager")
    return per.groupBy("domain").agg(stats.as_map_text("manager", "n").alias("counts"))


@plan(f"select {_DOMAIN} as domain, count(*)::bigint as n from pages where {_DOMAIN} in ('example.net', 'example.org') group by 1 having count(*) > 10")
def domain_allow_list(spark, sf_dir):
    return stats.counts(_domains(spark, sf_dir).filter(F.col("domain").isin("example.net", "example.org")), "domain", least=11)


@plan("select page_id, u.i::int as pos, u.href from (select page_id, regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1) as h from pages), lateral (select unnest(h) as href, generate_subscripts(h, 1) - 1 as i) u")
def page_hrefs(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))


_IGN = " or ".join(f"starts_with(href, '{x}') or suffix(href, '{x}')" for x in urls.IGNORE_ENDS)
_FILES = " or ".join(f"suffix(href, '{x}')" for x in urls.FILE_ENDINGS)


@plan(f"select href, ({_IGN}) as ignored, ({_FILES}) as is_file, count(*)::bigint as n from (select unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) as href from pages) group by all")
def href_ignore_filter(spark, sf_dir):
    rows = _pages(spark, sf_dir).select(F.explode(html.hrefs(F.col("html"))).alias("href"))
    return rows.groupBy("href", urls.at_either_end(F.col("href"), urls.IGNORE_ENDS).alias("ignored"), urls.file_link(F.col("href")).alias("is_file")).agg(F.count(F.lit(1)).alias("n"))


_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@plan(f"select page_id, md5({_TEXT}) as digest, length({_TEXT})::int as n_chars from pages")
def page_text(spark, sf_dir):
    t = html.visible_text(F.col("html"))
    return _pages(spark, sf_dir).select("page_id", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


_HEADS = "list_transform(regexp_extract_all(html, '(?s)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


@plan(f"""with h as (select page_id, unnest({_HEADS}) as t, generate_subscripts({_HEADS}, 1) as i from pages), c as (select *, len(list_filter(string_split(t, ' '), lambda w: w <> '')) as k from h),
r as (select * from c where k between 4 and 50 qualify row_number() over (partition by page_id order by k desc, i) <= 3)
select p.page_id, coalesce(string_agg(t, '|' order by k desc, i), '') as titles from pages p left join r using (page_id) group by 1""")
def page_titles_top3(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.array_join(html.top_titles(F.col("html")), "|").alias("titles"))


_PARAS = "list_transform(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))"


@plan(f"""with p as (select page_id, unnest({_PARAS}) as paragraph, (generate_subscripts({_PARAS}, 1) - 1)::int as pos from pages), c as (select *, len(list_filter(string_split(paragraph, ' '), lambda w: w <> '')) as n from p),
w as (select *, max(n) over (partition by page_id order by pos rows between 3 preceding and 1 preceding) as b, max(n) over (partition by page_id order by pos rows between 1 following and 3 following) as a from c)
select page_id, pos, paragraph from w where n >= 10 and b > 10 and a > 10""")
def paragraph_context_filter(spark, sf_dir):
    return html.context_paragraphs(_pages(spark, sf_dir), "page_id")


@plan("select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, split_part(url, '?utm_source', 1) as stripped from pages")
def ref_origin(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", urls.origin(F.col("url")).alias("origin"), urls.before(F.col("url"), "?utm_source").alias("stripped"))


@plan("select page_id, len(regexp_extract_all(url || ' and ' || url, 'https?://\\S+'))::int as n_urls from pages")
def urls_in_text(spark, sf_dir):
    u = F.col("url")
    return _pages(spark, sf_dir).select("page_id", F.size(urls.in_text(F.concat(u, F.lit(" and "), u))).alias("n_urls"))


@plan(f"""with f as (select page_id, {_DOMAIN} as d, string_split({_HOST}, '.')[-3] as s from pages), l as (select a.d as first, b.d as second from f a join f b on b.page_id = a.page_id + 1)
select second, count(*)::bigint as n from l where first <> second group by 1 having count(*) > 5""")
def second_hop_domains(spark, sf_dir):
    d = _pages(spark, sf_dir).select("page_id", urls.registered_domain(F.col("url")).alias("second"))
    pairs = d.join(d.select((F.col("page_id") + 1).alias("page_id"), F.col("second").alias("first")), "page_id")
    return stats.counts(pairs.filter("first <> second"), "second", least=6)


def _decoded(sql):
    """SQL of a text with the pages' entities replaced; the last semicolon may be cut off."""
    for name, shown in (("quot", '"'), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        sql = f"regexp_replace({sql}, '&{name};?', '{shown}', 'g')"
    return sql


_PLAIN = _decoded("trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))")


@plan(f"""with h as (select page_id, 0 as i, 'h1' as kind, unnest(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)) as x from pages),
p as (select page_id, unnest(string_split(html, '<p>')[2:]) as x, generate_subscripts(string_split(html, '<p>')[2:], 1) as i from pages),
b as (select page_id, i, kind, {_PLAIN} as text from h union all select page_id, i, 'p', {_PLAIN.replace("regexp_replace(x, '(?s)<", "regexp_replace(regexp_replace(x, '(?s)(</p>|</article>|<footer>).*', ''), '(?s)<")} from p),
f as (select page_id, kind, text, min(i) as i from b where text <> '' group by all)
select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, kind, text from f""")
def page_blocks(spark, sf_dir):
    """Ordered blocks by the parser; the given pages' blocks are flat enough for SQL to say them too."""
    rows = _pages(spark, sf_dir).select("page_id", F.posexplode(html.blocks("html")).alias("pos", "b"))
    return rows.select("page_id", "pos", "b.kind", "b.text")


@plan()
def page_summary(spark, sf_dir):
    """The article's body of every page: the element whose paragraphs score highest, navigation and link lists left out."""
    out = pagetree.read_pages(_pages(spark, sf_dir), "page_id")
    return out.select("page_id", "tag", F.round("score", 4).alias("score"), F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


_H1 = f"list_transform(regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), lambda x: {_decoded("trim(regexp_replace(x, '\\s+', ' ', 'g'))")})"
_MARKED = "url || ' of ' || page_id::varchar || ' in two'"


@plan(f"""with t as (select page_id, list_append({_H1}, {_MARKED}) as titles from pages), e as (select page_id, unnest(titles) as title, generate_subscripts(titles, 1) as i from t),
o as (select page_id, title, min(i) as i from e where title <> '' group by all), c as (select *, len(string_split(title, ' ')) as k from o), r as (select * from c where k between 4 and 50 qualify row_number() over (partition by page_id order by k desc, i) <= 3)
select p.page_id, coalesce(string_agg(title, '|' order by k desc, i), '') as titles, max('pip install ' || p.page_id::varchar || chr(10) || '  # ' || url) as codes from pages p left join r using (page_id) group by 1""")
def page_header_titles(spark, sf_dir):
    """Titles from h1 to h3 and from elements with a header class, here one with an element of the same name in it, and code."""
    more = F.concat(F.lit('<div class="x Page-Header">'), F.col("url"), F.lit(" of <div>"), F.col("page_id").cast("string"), F.lit("</div> in two</div><pre><code>\npip install "), F.col("page_id").cast("string"), F.lit("\n  # "), F.col("url"), F.lit(" </code></pre>"))
    pages = _pages(spark, sf_dir).withColumn("html", F.concat("html", more))
    out = pagetree.read_pages(pages, "page_id")
    return out.select("page_id", F.array_join(html.fit_titles(F.col("titles")), "|").alias("titles"), F.array_join("codes", "|").alias("codes"))


def _links(page):
    return [("link", h) for h in re.findall('<a href="([^"]*)"', page)]


def _title(page):
    found = re.search("(?s)<title>(.*?)</title>", page)
    if not found:
        raise ValueError("no title")
    return [("title", found[1])]


_SOURCE = "string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.')[-1]"


@plan(f"""with p as (select page_id, {_SOURCE} as source, html, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h, regexp_extract_all(html, '(?s)<title>(.*?)</title>', 1) as t from pages)
select page_id, source, (u.i - 1)::int as pos, 'link' as kind, u.x as text, null::varchar as error from p, lateral (select unnest(h) as x, generate_subscripts(h, 1) as i) u where source = 'org'
union all select page_id, source, case when len(t) > 0 then 0 end, case when len(t) > 0 then 'title' end, t[1], case when len(t) = 0 then 'ValueError: no title' end from p where source = 'com'
union all select page_id, source, null, null, null, 'no extractor' from p where source not in ('org', 'com')""")
def extract_by_source(spark, sf_dir):
    """Two extractors chosen by a page's source through a table function; other sources are error rows."""
    pages = _pages(spark, sf_dir).withColumn("source", F.element_at(F.split(urls.host(F.col("url")), "\\."), -1))
    return extract.extract_by_source(pages, {"org": _links, "com": _title}, "page_id")
