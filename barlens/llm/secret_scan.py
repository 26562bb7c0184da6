"""Secrets in documents, and which of them look alive. DataFrame functions only.

Three patterns give the base spans: assignments to a telling name, access keys, and long runs of hexadecimal digits. Matches
are leftmost and do not overlap within a kind; those too short are dropped after matching. Positions are code points.

The verdict on a value is corpus-wide. Candidates are the values of all base spans and, besides, all runs of RUN, as far as they
look random: a letter, a digit and DISTINCT different characters. Their SHA-256 digests are counted by repository, then by owner,
then as a whole, each step summed before rows move, so a value that stands in a third of all documents is a few rows:

* one owner has it, however often: it looks *live*, and every place where it stands gets a span of kind ``live``;
* EXAMPLES owners or more have it: it is *copied*, an example of the kind that documentation and tutorials repeat;
* otherwise it is neither.

Base spans stay whatever the verdict. Defined results: null and empty texts have no spans; an unknown owner or repository is one
of its own; a null ``doc_id`` keeps its row, and repeated rows keep a row each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import settle


def _either(word: str) -> str:
    """A pattern of the word with its letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The kinds in order, each with its pattern, the group that holds the value, and the least length of that group.
KINDS = (
    ("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)
LIVE = "live"
RUN, DISTINCT = "[A-Za-z0-9+/_-]{20,}", 10
EXAMPLES = 3
#: Steps of a running sum that are added up directly.
STRETCH = 64
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body or a function inside it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(steps: Column) -> Column:
    """Running sums of an array of integers, by stretches: far fewer steps than adding up from the start for each."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def summed(s: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / STRETCH).cast("int")), lambda b: add(F.slice(s, b * STRETCH + 1, F.lit(STRETCH))))
        before = let(stretches, lambda b: F.transform(b, lambda x, i: add(F.slice(b, F.lit(1), i))))
        return let(before, lambda p: F.transform(s, lambda x, i: F.get(p, (i / STRETCH).cast("int")) + add(F.slice(s, (i / STRETCH).cast("int") * STRETCH + 1, i % STRETCH + 1))))

    return let(steps, lambda s: F.when(F.size(s) > 0, summed(s)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost matches of a pattern whose ``group`` has ``least`` characters: start, kind, end and the group's text."""

    def spans(v: Column) -> Column:
        # what precedes a match: the text since the last one, and that one
        steps = F.transform(v["hits"], lambda h, i: F.length(F.get(v["rest"], i)) + F.when(i > 0, F.length(F.get(v["hits"], i - 1))).otherwise(0))
        made = let(running(steps), lambda at: F.transform(v["hits"], lambda h, i: F.struct(F.get(at, i).alias("start"), F.lit(kind).alias("kind"), (F.get(at, i) + F.length(h)).alias("end"), F.get(v["values"], i).alias("value"))))
        return F.filter(made, lambda s: F.length(s["value"]) >= least)

    def split(hits: Column) -> Column:
        values = hits if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        return F.when(F.size(hits) > 0, let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("rest"), values.alias("values")), spans)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), split)


def looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*(F.lit(n) for n, *_ in KINDS), F.lit(LIVE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value, n_owners, n_repositories, n_places)`` of a table ``(value, owner, repository)``; every step sums map-side."""
    one = candidates.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n_places"))
    two = one.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n_places").alias("n_places"))
    return two.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n_places").alias("n_places"))


def scan(docs: DataFrame, *, owner: Column, repository: Column, examples: int = EXAMPLES) -> DataFrame:
    """``(doc_id, spans, n_live, n_copied)`` per row; ``spans`` are ``(start, kind, end)`` by start and kind.

    ``kind`` numbers KINDS, then LIVE. ``n_live`` and ``n_copied`` count the places of candidates with that verdict. ``owner``
    and ``repository`` are columns of ``docs``; a repository is known by its owner and name.
    """
    text = F.coalesce("text", F.lit(""))
    own = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    read = docs.select("doc_id", own(owner).alias("owner"), own(repository).alias("repository"), F.concat(*(matches(text, rx, k, group, least) for k, (_, rx, group, least) in enumerate(KINDS))).alias("base"), matches(text, RUN, 3).alias("runs"))

    def candidates(both: Column) -> Column:
        # an assignment's value ends where its match ends; a place that several patterns give counts once
        places = F.transform(F.filter(both, lambda s: looks_random(s["value"])), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value")))
        return F.array_distinct(places)

    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    read = settle(read.select("doc_id", "owner", "repository", F.sort_array(bare).alias("base"), candidates(F.concat("base", "runs")).alias("found")))
    # rows of a checkpoint are the same at each reading, so their numbers are too
    read = read.withColumn("row", F.monotonically_increasing_id())
    each = read.where(F.size("found") > 0).select("row", "owner", "repository", F.inline("found"))
    verdict = ownership(each.select("value", "owner", "repository")).select("value", (F.col("n_owners") == 1).alias("live"), (F.col("n_owners") >= examples).alias("copied"))
    live = F.when(F.col("live"), F.struct("start", F.lit(len(KINDS)).alias("kind"), "end"))
    judged = each.join(verdict, "value").groupBy("row").agg(F.collect_list(live).alias("added"), F.count_if("copied").alias("n_copied"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    spans = F.sort_array(F.when(F.size("added") > 0, F.concat("base", "added")).otherwise(F.col("base")))
    return read.join(judged, "row", "left").select("doc_id", "base", spans.alias("spans"), count(F.when(F.col("added").isNotNull(), F.size("added"))).alias("n_live"), count(F.col("n_copied")).alias("n_copied"))


def report(found: DataFrame) -> DataFrame:
    """Counts of each base kind, the digest of the base spans and the text of all spans."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k][0]}")
    return found.select("doc_id", *map(of, range(len(KINDS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_copied")
