"""Secrets in texts, told from copied examples by how many own them (DataFrame operations only).

Fixed patterns give the base spans. Besides, every long token that looks random is a candidate. Its
hash is counted over the corpus by distinct repositories and owners: a token that several owners
have is an example everyone copied, one that a single owner has in a few repositories is a live
credential and adds a span of its own.

A match's place is the running sum of what a split by the same pattern leaves between matches,
folded in blocks within the row. Tokens and texts that a third of all rows may hold are looked up by
broadcast (tokens above a thousandth of all: at most a thousand) or dealt out by a salt (texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import quoted
from tabloom.llm.common import row_count, whole_text
from tabloom.sources.work import WorkArea

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
    r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+_-]{16,}"
ASSIGNED = 8
KINDS = ("assign", "access", "hex", "live")
#: A candidate has a letter, a digit and at least so many different characters.
VARIETY = 8
#: So many owners make a token an example; one owner with at most so many repositories, a live one.
EXAMPLE_OWNERS = 3
LIVE_REPOSITORIES = 8
#: Matches folded at once; keys above this share of the rows count as hot.
BLOCK = 1000
HOT_SHARE = 1000


def find_secrets(
    docs: DataFrame,
    area: WorkArea,
    text_col: str = "text",
    repository_col: str = "doc_id",
    owner_col: str = "source",
) -> DataFrame:
    """One row per document: `repository_col`, `assign`, `access`, `hex`, `live` (arrays of spans with
    start and end in code points, end exclusive) and `n_example`, the number of copied examples.

    A base span is the whole match: `assign` has a value of 8 characters or more, `access` 16 or
    more, `hex` 32 or more. A `live` span is a candidate token that one owner has, in at most 8
    repositories; an example is one that 3 owners or more have. Both may lie inside base spans.

    Null and empty texts hold nothing; texts of any length are searched whole. A null owner counts
    as one owner, a row without a repository as a repository of its own text. Repeated rows have
    equal results and count once. An empty table gives no rows. Only the three columns are read,
    so the names of others can't clash. `area` must live until the result has been used.
    """
    found = area.table(_matches(docs, text_col, repository_col, owner_col), "found")
    marks = _marks(found, area)
    joined = _join_by_text(found, marks)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return joined.select(
        F.col("repository").alias(repository_col),
        "assign",
        "access",
        "hex",
        F.coalesce("live", none).alias("live"),
        F.coalesce("examples", F.lit(0)).cast("long").alias("n_example"),
    )


def spans_text(spans: dict[str, Column]) -> Column:
    """`kind:start:end` of all spans, comma-joined, by start and then by kind."""

    def numbered(spans: Column, number: int) -> Column:
        return F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))
        )

    listed = F.flatten(F.array(*(numbered(column, KINDS.index(kind)) for kind, column in spans.items())))
    names = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(
        F.transform(
            F.array_sort(listed),
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _matches(docs: DataFrame, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """Base spans and candidate tokens of every row, without its text."""
    read = docs.select(
        quoted(repository_col).alias("repository"),
        quoted(owner_col).cast("string").alias("owner"),
        whole_text(quoted(text_col)).alias("text"),
    )
    searched = read.select(
        "repository",
        "owner",
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        *(_search(name, pattern, group) for name, pattern, group in _PATTERNS),
    )
    placed = searched.select(
        "repository", "owner", "digest", *(_places(name).alias(name) for name, _, _ in _PATTERNS)
    )

    def plain(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    random = F.filter("token", lambda s: _looks_random(s["value"]))
    candidates = F.transform(
        random, lambda s: F.struct(F.sha2(s["value"], 256).alias("hash"), s["start"].alias("start"), s["end"].alias("end"))
    )
    long_enough = F.filter("assign", lambda s: F.char_length(s["value"]) >= ASSIGNED)
    return placed.select(
        "repository",
        "owner",
        "digest",
        plain(long_enough).alias("assign"),
        plain(F.col("access")).alias("access"),
        plain(F.col("hex")).alias("hex"),
        candidates.alias("candidates"),
        F.monotonically_increasing_id().alias("row"),  # kept by the table this is written to
    )


#: (name, pattern, group that holds the value).
_PATTERNS = (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("token", TOKEN, 0))


def _looks_random(token: Column) -> Column:
    variety = F.size(F.array_distinct(F.split(token, ""))) >= VARIETY
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & variety


def _search(name: str, pattern: str, group: int) -> Column:
    """Per match: characters since the last one, its own characters, its value."""
    text = F.col("text")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    between = F.split(text, pattern, -1)
    step = F.arrays_zip(
        F.transform(F.slice(between, F.lit(1), F.size(between) - 1), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        values.alias("value"),
    )
    return F.when(text.rlike(pattern), step).alias(name)


def _places(name: str) -> Column:
    """Array of (start, end, value): running sums, folded block by block to stay linear."""
    steps = F.coalesce(F.col(name), F.array().cast("array<struct<gap:int,size:int,value:string>>"))
    span = "array<struct<start:int,end:int,value:string>>"
    none, blocks_of = F.array().cast(span), F.array().cast(f"array<{span}>")

    def one(held: Column, step: Column) -> Column:
        start = held["at"] + step["gap"]
        end = start + step["size"]
        spanned = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(held["out"], spanned).alias("out"))

    def block(held: Column, steps_of: Column) -> Column:
        folded = F.aggregate(steps_of, F.struct(held["at"].alias("at"), none.alias("out")), one)
        # An array of one element, so that the fold is computed once.
        return F.transform(
            F.array(folded), lambda x: F.struct(x["at"].alias("at"), F.array_append(held["out"], x["out"]).alias("out"))
        )[0]

    count = F.size(steps)
    starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda first: F.slice(steps, first, F.lit(BLOCK)))
    begun = F.struct(F.lit(0).alias("at"), blocks_of.alias("out"))
    return F.flatten(F.aggregate(blocks, begun, block)["out"])


def _marks(found: DataFrame, area: WorkArea) -> DataFrame:
    """Live spans and the number of examples by text, for texts that have any."""
    holders = found.select(
        F.explode(F.array_distinct("candidates.hash")).alias("hash"),
        "owner",
        F.coalesce(F.col("repository").cast("string"), "digest").alias("repository"),
    )
    # Distinct holders first, then repositories of an owner, then owners: each level combines
    # rows before it shuffles them.
    by_owner = holders.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    spread = by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories")
    )
    kind = F.when(F.col("owners") >= EXAMPLE_OWNERS, "example").when(
        (F.col("owners") == 1) & (F.col("repositories") <= LIVE_REPOSITORIES), "live"
    )
    classes = area.table(spread.select("hash", kind.alias("class")).filter("class IS NOT NULL"), "classes")

    texts = found.filter(F.size("candidates") > 0).groupBy("digest").agg(F.first("candidates").alias("candidates"))
    tokens = area.table(texts.select("digest", F.explode("candidates").alias("c")).select("digest", "c.*"), "tokens")
    everything = row_count(tokens)
    often = tokens.groupBy("hash").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") * HOT_SHARE > everything)
    often = often.join(classes, "hash", "left").select("hash", F.coalesce("class", F.lit("")).alias("often"))
    marked = tokens.join(F.broadcast(often), "hash", "left")
    hot = marked.filter("often <> ''").withColumnRenamed("often", "class")
    rest = marked.filter("often IS NULL").drop("often").join(classes, "hash")
    span = F.struct("start", "end")
    return (
        hot.unionByName(rest)
        .groupBy("digest")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("class") == "live", span))).alias("live"),
            F.count_if(F.col("class") == "example").alias("examples"),
        )
    )


def _join_by_text(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Add a text's marks to its rows. Rows without candidates need none; the rows of a text that
    makes up more than a thousandth of the others are dealt out, and its marks are repeated."""
    without = found.filter(F.size("candidates") == 0)
    others = found.filter(F.size("candidates") > 0)
    limit = F.lit(max(1, -(-row_count(others) // HOT_SHARE)))
    copies = others.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > limit)
    hot = copies.select("digest", F.ceil(F.col("copies") / limit).cast("int").alias("salts"))
    salted = others.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(0)).cast("int")
    )
    dealt = marks.join(F.broadcast(hot), "digest", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    )
    joined = salted.drop("salts").join(dealt.drop("salts"), ["digest", "salt"], "left").drop("salt")
    return joined.unionByName(without, allowMissingColumns=True)
