"""Line dedup: windows of three consecutive lines that repeat anywhere in the corpus lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm.common import materialize, text_or_empty

# A line ends at a newline, or after a full stop, question or exclamation mark with a space behind it.
ENDS = ("\n", ". ", "! ", "? ")
LINE_END = "(?<=\\n)|(?<=[.!?] )"
# A line of more bytes (UTF-8) ends behind each comma and space as well, so that a passage in long sentences has three
# whole lines although its first and last run on into other text.
LONG, LONG_END = 150, ", "
# What is left off at both ends of a line before it is compared; a line with nothing else has no word.
BLANK = " \\n\\r\\t"


def _lines(text: str) -> str:
    """SQL of the lines with their ends, so that joining them gives the text back.

    A separator is put behind each end, and the text is split at separators; a text that has the separator itself is cut
    by the regular expression, which gives the same lines (more slowly).
    """
    marked = text
    for end in ENDS:
        shown = end.replace("\n", "\\n")
        marked = f"replace({marked}, '{shown}', '{shown}\\u0001')"
    regex = LINE_END.replace("\\", "\\\\")
    cut = lambda lines, parts: f"flatten(transform({lines}, x -> case when octet_length(x) > {LONG} then {parts} else array(x) end))"
    plain = cut(f"split({marked}, '\\u0001', -1)", f"split(replace(x, '{LONG_END}', '{LONG_END}\\u0001'), '\\u0001', -1)")
    rare = cut(f"split({text}, '{regex}', -1)", f"split(x, '(?<={LONG_END})', -1)")
    return f"case when {text} = '' then array() when contains({text}, '\\u0001') then {rare} else {plain} end"


def windows(docs: DataFrame, width: int = 3, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, pos, ends, h1, h2): every window of `width` consecutive lines that have a word.

    pos and ends are the indexes of its first and last line among all lines. A text with fewer such lines is one
    window. h1 and h2 are two 64-bit hashes of the lines without white space at their ends (128 bits together).
    Windows of fewer than `min_words` words are left out. th tells rows with the same doc_id apart.
    """
    a = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("_text"))
    a = a.select("doc_id", F.xxhash64("_text").alias("th"), F.expr(_lines("_text")).alias("_l"))
    a = a.select("doc_id", "th", F.expr(f"filter(transform(_l, (x, i) -> struct(i as i, trim(both '{BLANK}' from x) as x)), s -> s.x <> '')").alias("_l"))
    count = ", size(split(s.x, '[\\\\s]+')) as n" if min_words > 1 else ""
    a = a.select("doc_id", "th", F.expr(f"transform(_l, s -> struct(s.i as i, xxhash64(s.x) as h, xxhash64('#', s.x) as g{count}))").alias("_l"))
    # the last start is the first for short texts; get() is null past the end, and hashes pass over nulls
    parts = lambda f: ", ".join(f"get(_l, j + {k}).{f}" for k in range(width))
    words = ", " + " + ".join(f"coalesce(get(_l, j + {k}).n, 0)" for k in range(width)) + " as n" if min_words > 1 else ""
    each = f"struct(_l[j].i as pos, get(_l, least(j + {width}, size(_l)) - 1).i as ends, xxhash64({parts('h')}) as h1, xxhash64({parts('g')}) as h2{words})"
    starts = f"case when size(_l) = 0 then array() else transform(sequence(0, greatest(size(_l) - {width}, 0)), j -> {each}) end"
    a = a.select("doc_id", "th", F.explode(F.expr(starts)).alias("w")).select("doc_id", "th", "w.*")
    return a.filter(F.col("n") >= min_words).drop("n") if min_words > 1 else a


def repeated_positions(docs: DataFrame, width: int = 3, min_words: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, spans): lines covered by later occurrences of repeated windows, as an array of (pos, ends): runs of
    windows that share a line are merged.

    The first occurrence is the one with the least (doc_id, pos); a null doc_id is after all others. Windows are counted
    by the first hash alone; only those whose first hash repeats carry their places on, and both hashes tell them apart
    (a window that shares just the first one with another is the first of its own kind, so it stays).
    """
    found = materialize(windows(docs, width, min_words, doc_id, text), "windows")
    twice = materialize(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"), "repeats")
    found = materialize(found.join(twice, "h1"), "repeated")
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("pos").alias("p"))
    heads = found.groupBy("h1", "h2").agg(F.min(order).alias("head"))
    heads = materialize(heads.select("h1", "h2", F.col("head.d").alias("hd"), F.col("head.t").alias("ht"), F.col("head.p").alias("hp")), "heads")
    later = found.join(heads, ["h1", "h2"]).filter("not (doc_id <=> hd and th = ht and pos = hp)").select("doc_id", "th", "pos", "ends")
    spans = later.distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("pos", "ends"))).alias("_s"))
    # pos and ends both ascend: a run starts where the window before ends earlier, and ends where the next starts later
    starts = "filter(_s, (s, i) -> i = 0 or s.pos > get(_s, i - 1).ends)"
    lasts = "filter(_s, (s, i) -> i = size(_s) - 1 or get(_s, i + 1).pos > s.ends)"
    return spans.select("doc_id", "th", F.expr(f"zip_with({starts}, {lasts}, (a, b) -> struct(a.pos as pos, b.ends as ends))").alias("spans"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, min_words: int = 1, run_words: int = 1, drop_emptied: bool = False, count: str = "n_lines_removed") -> DataFrame:
    """Every input row and column, with `text` cleaned, and the number of removed lines added at the end as `count`.

    Repeated windows of `width` lines lose all but their first occurrence (in order of doc_id, then position); covered
    positions of overlapping windows merge into runs, and their lines go. A caller may ask for more words as evidence of a
    copy: `min_words` is the least of a window and `run_words` the least of a run; by default every repeat goes. Texts
    without a repeat, null and empty ones stay as they are. Rows that repeat both doc_id and text lose the same lines (they
    are one document); with equal doc_ids but other texts they are ordered by a hash of the text, and a null doc_id comes
    last. `drop_emptied` leaves out rows that lost every line with a word. Other columns are carried through, whatever
    their names, but `count` must be a new one: the name of a column that is there is an error. An empty table gives an empty result.
    """
    if count in docs.columns:
        raise ValueError(f"the table has a column {count!r}: name the number of removed lines otherwise (count=)")
    spans = materialize(repeated_positions(docs, width, min_words, doc_id, text), "spans")
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names of this function's own from here on
    body, key = at[text], at[doc_id]
    own = docs.toDF(*at.values())
    # texts meet the spans in one way at every size: a plan that broadcasts a small table says nothing about a large one
    out = own.join(spans.hint("merge"), own[key].eqNullSafe(spans["doc_id"]) & (F.xxhash64(text_or_empty(body)) == spans["th"]), "left")
    out = out.select(*own.columns, "spans", F.when(F.col("spans").isNotNull(), F.expr(_lines(f"coalesce(cast({body} as string), '')"))).alias("lines"))
    words = "regexp_count(array_join(slice(l, r.pos + 1, r.ends - r.pos + 1), ''), '[^\\\\s]+')"
    out = out.withColumn("runs", F.expr(f"element_at(transform(array(lines), l -> filter(spans, r -> {words} >= {int(run_words)})), 1)" if run_words > 1 else "spans"))
    out = out.withColumn("n", F.coalesce(F.expr("aggregate(runs, 0, (n, r) -> n + r.ends - r.pos + 1)"), F.lit(0)))
    # a filter that is pushed down puts the columns' expressions in place of their names: bound names are worked out once
    kept = F.expr("element_at(transform(array(runs), q -> array_join(filter(lines, (x, i) -> not exists(q, r -> i between r.pos and r.ends)), '')), 1)")
    out = out.withColumn("new", F.when(F.col("n") > 0, F.rtrim(kept)).otherwise(F.col(body).cast("string")))
    if drop_emptied:
        out = out.filter((F.col("n") == 0) | F.col("new").rlike("[^\\s]"))
    return out.select(*(F.col("new" if c == text else at[c]).alias(c) for c in docs.columns), F.col("n").alias(count))
