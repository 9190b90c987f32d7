"""Tokens, candidate names, cleaning, keyword weights and chunking."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import stored

WORD = "[\\p{L}\\p{N}_]+"
# A candidate package name: an optional scope, then at least two name characters.
CANDIDATE = "(?:@[a-zA-Z0-9\\-]+\\/)?[a-zA-Z0-9][a-zA-Z0-9\\._\\-]+"

# Keyword categories in order of precedence, with their weights.
KEYWORDS: dict[str, tuple[int, list[str]]] = {
    "malicious": (5, ["malicious", "security", "malware", "backdoor", "phishing", "cryptojacking", "typosquatting", "bitsquatting", "compromise", "ransomware", "trojan", "virus", "worm", "spyware", "adware", "botnet", "rootkit", "keylogger", "attack", "attacker", "injection", "hijacking", "spoofing", "obfuscation"]),
    "malicious_behavior": (3, ["code execution", "information stealing", "remote control", "ransomware", "mining", "trojan", "backdoor", "zombie network", "encryption", "decryption", "encoding", "decoding", "injection", "overflow", "attack"]),
    "package_manager": (2, ["npm", "pypi", "python", "javascript", "js", "pypi.org", "npmjs.com", "nuget", "golang", "maven", "rubygems", "packagist", "cargo", "composer", "hackage", "cran", "conda", "swift", "cocoapods", "script", "code", "package.json", "requirements.txt", "package-lock.json", "pipfile", "pipfile.lock", "yarn.lock", "Gemfile", "Gemfile.lock", "Podfile", "Podfile.lock", "Cargo.toml", "Cargo.lock", "composer.json", "composer.lock", "Rakefile", "Gemspec"]),
    "oss": (1, ["registry", "package", "supply chain", "component", "dependency", "open source", "ecosystem", "conduct", "maintain", "maintainers", "maintainance", "management", "manager"]),
}


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def candidates(text: Column, common: Sequence[str] = (), stop: Sequence[str] = (), lower_stop: bool = False) -> Column:
    """Distinct candidate names of a text: one trailing full stop or comma off, common words (any case) and stop words out.

    The stop words are compared as written, or in lower case with `lower_stop`.
    """
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    found = F.array_distinct(F.transform(found, lambda w: F.regexp_replace(w, "[.,]$", "")))
    if common:
        found = F.filter(found, lambda w: ~F.lower(w).isin(*common))
    if stop:
        found = F.filter(found, lambda w: ~(F.lower(w) if lower_stop else w).isin(*stop))
    return found


def keyword_weights(categories: Mapping[str, tuple[int, Sequence[str]]] = KEYWORDS) -> dict[str, int]:
    """Each word with the weight of the first category that has it."""
    out: dict[str, int] = {}
    for weight, names in categories.values():
        for w in names:
            out.setdefault(w, weight)
    return out


def keyword_score(text: Column, weights: Mapping[str, int] | None = None) -> Column:
    """Sum over a text's words of their weights; a fixed small table, so it stays in the row without a join."""
    weights = keyword_weights() if weights is None else weights
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.aggregate(words(text), F.lit(0).cast("long"), lambda s, w: s + F.coalesce(F.try_element_at(table, w), F.lit(0)).cast("long"))


def strip_templates(text: Column) -> Column:
    """{...} and <...> blanked, shortest first, over line ends."""
    return F.regexp_replace(F.regexp_replace(text, "(?s)\\{.*?\\}", " "), "(?s)<.*?>", " ")


def name_like_tokens(text: Column) -> Column:
    """White-space tokens of the stripped text that look like names."""
    return F.filter(F.split(F.trim(strip_templates(text)), "\\s+"), lambda w: w.rlike("^[a-zA-Z][a-zA-Z0-9@/_-]*$"))


def alpha_tokens(text: Column, stop: Sequence[str] = ()) -> Column:
    """Lower-case tokens of letters only, without stop words."""
    found = F.filter(F.split(F.trim(F.lower(text)), "\\s+"), lambda w: w.rlike("^\\p{L}+$"))
    return F.filter(found, lambda w: ~w.isin(*stop)) if stop else found


def chunk(pieces: Column, most: int) -> Column:
    """Greedy packing of an array of strings into chunks of at most `most` characters (a longer piece is its own chunk)."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["open"] == "") | (F.length(s["open"]) + F.length(x) + 1 <= most)
        joined = F.when(s["open"] == "", x).otherwise(F.concat(s["open"], F.lit(" "), x))
        done = F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["open"]))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))


def abbreviated(text: Column) -> Column:
    """First two words ... last two words; texts of up to four words as they are."""
    w = F.split(text, " ")
    short = F.concat(F.array_join(F.slice(w, 1, 2), " "), F.lit(" ... "), F.array_join(F.slice(w, -2, 2), " "))
    return F.when(F.size(w) <= 4, text).otherwise(short)


def printable(text: Column) -> Column:
    return F.regexp_replace(text, "[^\\x20-\\x7E]", "")


def without_fence(text: Column) -> Column:
    """A text without the Markdown fence around it, if it has one."""
    return F.trim(F.regexp_replace(F.trim(text), "^```[a-zA-Z]*\\s*|\\s*```$", ""))


def without_comments(text: Column) -> Column:
    """The other rule for fenced JSON: the inside of the first fence wherever it is, and line comments off; '' for a null."""
    inside = F.regexp_extract(F.coalesce(text, F.lit("")), "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    body = F.coalesce(F.nullif(inside, F.lit("")), text, F.lit(""))
    return F.regexp_replace(F.regexp_replace(body, "(?m)^[ \\t]*//.*$", ""), "^\\s+|\\s+$", "")


def bracketed(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    return F.nullif(F.regexp_extract(text, "(?s)\\[.*\\]", 0), F.lit(""))


def label(value: Column) -> Column:
    return F.replace(value, F.lit("_"), F.lit(" "))


def scoped(name: Column) -> Column:
    """A directory name's ## back to /."""
    return F.replace(name, F.lit("##"), F.lit("/"))


def search_phrase(name: Column, manager: Column) -> Column:
    return F.format_string('"%s" %s malicious package', name, manager)


def followed(docs: DataFrame, tokens: str) -> DataFrame:
    """(a, b, n): how often b follows a in the documents of a batch; after a document's last token b is null. A pair comes once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(0).value_lengths().fill_null(0).to_numpy()
            coded = batch.column(0).flatten().dictionary_encode(null_encoding="encode")
            a, end = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            b = np.r_[a[1:], end][: len(a)]
            b[np.cumsum(sizes)[sizes > 0] - 1] = end
            pairs, n = np.unique(a * (end + 1) + b, return_counts=True)
            for at in range(0, len(pairs), 1 << 16):
                a, b = np.divmod(pairs[at : at + (1 << 16)], end + 1)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(a)), coded.dictionary.take(pa.array(b, mask=b == end)), pa.array(n[at : at + (1 << 16)])], ["a", "b", "n"])

    return docs.select(tokens).mapInArrow(run, "a string, b string, n long")


def bigrams(docs: DataFrame, tokens: str, min_count: int = 1, threshold: float = 2.0) -> DataFrame:
    """(a, b, n_ab, score) of collocations: (n_ab - min_count) * vocabulary / (n_a * n_b) over the threshold (0 or more).

    Tokens are read once, each with its follower, and counted a batch of documents at a time; words are summed from the written
    pairs, and only pairs that occur more than `min_count` times, the others' score being 0 at most, meet the words' counts.
    """
    two = stored(followed(docs, tokens).groupBy("a", "b").agg(F.sum("n").alias("n_ab")), "pairs")
    one = stored(two.groupBy(F.col("a").alias("w")).agg(F.sum("n_ab").alias("n")), "words")
    two = two.filter(F.col("b").isNotNull() & (F.col("n_ab") > min_count))
    size = one.agg(F.count(F.lit(1)).alias("v"))
    scored = two.join(one.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a").join(one.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    scored = scored.crossJoin(F.broadcast(size))  # one row
    return scored.select("a", "b", "n_ab", ((F.col("n_ab") - min_count) * F.col("v") / (F.col("n_a") * F.col("n_b"))).alias("score")).filter(F.col("score") > threshold)


def advisory_name(title: Column) -> Column:
    """The package in `Malicious code in name (manager)`; null for other titles."""
    name = F.regexp_extract(title, "^\\s*Malicious code in (.+?)(?:\\s+\\((?:npm|PyPI|pypi)\\))?\\s*$", 1)
    return F.nullif(F.trim(name), F.lit(""))


def name_and_version(text: Column) -> Column:
    """struct<name, version> of `name version ...`; the version is '' where there is none."""
    clean = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.struct(F.split_part(clean, F.lit(" "), F.lit(1)).alias("name"), F.split_part(clean, F.lit(" "), F.lit(2)).alias("version"))


def sentence_runs(text: Column, window: int = 3) -> Column:
    """Runs of `window` sentences, each starting one sentence later; shorter texts are one run."""
    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: s != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(sentences) - window + 1, F.lit(1)))
    return F.when(F.size(sentences) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(sentences, i, window), " ")))
